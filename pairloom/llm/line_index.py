"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is its SHA-256 after stripping and lower-casing. An index is a folder of tables, one version per change:

* ``holdings``: one row per key and document that holds it, appended by every insertion. Never rewritten;
  ``gone`` names deleted documents, whose rows of earlier versions no longer count.
* ``refs``: keys that at least two documents hold, with their exact number and the smallest document.
* ``filters``: one cuckoo filter per shard of keys, with a fingerprint for every key that any document holds.

An insertion asks the filters first: a key that is not in them is new, needs no look into the tables and gets a row in
``refs`` only if two documents of the batch hold it. Only keys that the filters know are counted again in
the tables, so an answer that is wrong by a fingerprint collision costs work and no result. A deletion counts the keys of
its documents again and takes those that nobody holds any more out of the filters. Deleting what was inserted
gives back the state before it.

A key that very many documents hold is no hot spot: counts are partial aggregates, and keys above a ten-thousandth of all
holdings (fewer than 10,000, whatever the data) are joined by broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.components import written
from pairloom.llm.shards import Shard, bucket_count, mix, pack, per_shard, with_notes
from pairloom.session import scratch_dir

MIN_POINTS = 10  # code points of a key
STRIPPED = b" \t\n\x0b\x0c\r"
SLOTS = 4  # fingerprints of a bucket
KICKS = 200  # rounds of evictions before a filter is doubled
FULL = 0.9  # share of slots filled before it is doubled
HOT = 10_000  # keys that more than one in so many holdings have are broadcast; there are fewer than this


class CuckooFilter:
    """A set of 32-bit fingerprints in buckets of four, each in one of two buckets that the fingerprint determines.

    As buckets depend on nothing but the fingerprint, a filter can be doubled without its keys, and equal fingerprints
    are equal in every way: removing either removes the right one. 0 marks a free slot. Fingerprints that find no place
    even after doubling (more than eight equal ones) go to ``stash``, so nothing is ever lost.
    """

    def __init__(self, table: np.ndarray | None = None, stash: np.ndarray | None = None) -> None:
        self.table = np.zeros((1, SLOTS), np.uint32) if table is None else table
        self.stash = np.zeros(0, np.uint32) if stash is None else stash

    @classmethod
    def load(cls, raw: bytes, stash: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint32).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.uint32).copy())

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def _buckets(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix(prints.astype(np.uint64))
        mask = np.uint64(len(self.table) - 1)
        first = mixed & mask
        return first.astype(np.int64), (first ^ ((mixed >> np.uint64(32)) & mask)).astype(np.int64)

    def contains(self, prints: np.ndarray) -> np.ndarray:
        one, two = self._buckets(prints)
        found = (self.table[one] == prints[:, None]).any(axis=1) | (self.table[two] == prints[:, None]).any(axis=1)
        return found | np.isin(prints, self.stash)

    def insert(self, prints: np.ndarray) -> None:
        waiting = np.concatenate((prints.astype(np.uint32), self.stash))
        self.stash = np.zeros(0, np.uint32)
        held = int(np.count_nonzero(self.table))
        while held + len(waiting) > FULL * self.table.size:
            waiting = np.concatenate((waiting, self._double()))
            held = 0
        waiting = self._settle(waiting)
        tries = 0
        while len(waiting) and tries < 2:
            waiting = self._settle(np.concatenate((waiting, self._double())))
            tries += 1
        self.stash = np.sort(waiting)

    def _double(self) -> np.ndarray:
        """Twice as many buckets, all free; returns what the table held."""
        held = self.table[self.table != 0]
        self.table = np.zeros((2 * len(self.table), SLOTS), np.uint32)
        return held

    def _settle(self, waiting: np.ndarray) -> np.ndarray:
        """Place fingerprints, evicting others in rounds; returns those without a place."""
        for kick in range(KICKS):
            for choice in (0, 1):
                waiting = self._place(waiting, self._buckets(waiting)[choice])
            if not len(waiting):
                break
            # One fingerprint per bucket takes the slot of another one, which looks for a place next.
            at = self._buckets(waiting)[kick % 2]
            _, turn = np.unique(at, return_index=True)
            slot = (waiting[turn].astype(np.int64) + kick) % SLOTS
            out = self.table[at[turn], slot]
            self.table[at[turn], slot] = waiting[turn]
            waiting[turn] = out
            waiting = waiting[waiting != 0]
        return waiting

    def _place(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fill free slots of the buckets ``at``; returns the fingerprints that found none."""
        order = np.argsort(at, kind="stable")
        prints, at = prints[order], at[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        free = self.table[at] == 0
        # The nth newcomer of a bucket takes its nth free slot.
        place = free & (np.cumsum(free, axis=1) == nth[:, None] + 1)
        row, slot = np.nonzero(place)
        self.table[at[row], slot] = prints[row]
        left = np.ones(len(at), bool)
        left[row] = False
        return prints[left]

    def remove(self, prints: np.ndarray) -> None:
        """Take out one fingerprint per entry of ``prints``; all of them must have been inserted."""
        left = np.sort(prints.astype(np.uint32))
        for choice in (0, 1):
            nth = np.arange(len(left)) - np.searchsorted(left, left)
            at = self._buckets(left)[choice]
            same = self.table[at] == left[:, None]
            row, slot = np.nonzero(same & (np.cumsum(same, axis=1) == nth[:, None] + 1))
            self.table[at[row], slot] = 0
            gone = np.zeros(len(left), bool)
            gone[row] = True
            left = left[~gone]
        for p in left.tolist():
            self.stash = np.delete(self.stash, np.flatnonzero(self.stash == p)[:1])


def line_key(line: bytes) -> bytes:
    """The line stripped and lower-cased, as far as ASCII goes."""
    return line.strip(STRIPPED).lower()


def digests(lines: list[bytes]) -> dict[bytes, bytes]:
    """The SHA-256 of each different key of at least ``MIN_POINTS`` code points."""
    keys = {line_key(line) for line in lines}
    return {k: hashlib.sha256(k).digest() for k in keys if len(k) >= MIN_POINTS and len(k.decode()) >= MIN_POINTS}


def holdings(docs: DataFrame) -> DataFrame:
    """``key``, ``doc`` for every key of ``doc_id``, ``text``, once per row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owner = [], []
            for row, text in enumerate(batch.column("text")):
                found = digests((text.as_py() or "").encode().split(b"\n")).values()
                out += found
                owner += [row] * len(found)
            doc = batch.column("doc").take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), doc], names=["key", "doc"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return pairs.mapInArrow(keys, HOLDINGS)


def counted(rows: DataFrame) -> DataFrame:
    """Keys with the number of their ``documents`` and the smallest one, ``keeper`` (null only if none has an id)."""
    return rows.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.min("doc").alias("keeper"))


def join_keys(rows: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """``rows`` with the columns of ``keys``, by ``key``. Keys of more than ``limit`` documents are broadcast."""
    hot = F.broadcast(keys.filter(F.col("documents") > limit))
    rest = rows.join(hot.select("key"), "key", "left_anti")
    return rows.join(hot, "key").unionByName(rest.join(keys.filter(F.col("documents") <= limit), "key"))


def fingerprints(keys: list[bytes]) -> np.ndarray:
    """The first four bytes of each digest; 0 is kept for free slots."""
    raw = np.frombuffer(b"".join(k[:4] for k in keys), "<u4").astype(np.uint32)
    return np.where(raw == 0, np.uint32(1), raw)


HOLDINGS, REFS = "key binary, doc long", "key binary, documents long, keeper long"
FILTERS = "shard int, buckets binary, stash binary"
CLEANED = "doc_id long, n_lines long, n_dropped long, kept string"


def _filter_of(rows: pa.Table) -> CuckooFilter:
    return CuckooFilter.load(rows["buckets"][0].as_py(), rows["stash"][0].as_py()) if rows.num_rows else CuckooFilter()


class LineIndex:
    """A reversible index of the lines of documents, in a folder that driver and executors share.

    Rows of one ``doc_id`` are one document, over all batches; null ids are one document that comes after
    all others. Null texts are empty. Other columns are not read. Every change is a new version: its tables are complete
    before a manifest names them, so a change that fails leaves the index as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None) -> None:
        self.spark = spark
        self.folder = folder or scratch_dir(spark, "lines")
        empty = {"version": 0, "shards": shards, "rows": 0, "holdings": [], "gone": [], "refs": None, "filters": None}
        self.state = self._latest() or empty

    # The tables

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict | None:
        pattern, files = self._files("manifest-*.json")
        found = [f.getPath().toString() for f in files.globStatus(pattern) or []]
        if not found:
            return None
        newest = max(found, key=lambda path: int(path.rsplit("-", 1)[1].split(".")[0]))
        return json.loads("".join(r.value for r in self.spark.read.text(newest).collect()))

    def _commit(self, state: dict) -> None:
        draft, files = self._files("manifest.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final, _ = self._files(f"manifest-{state['version']}.json")
        if not files.rename(draft, final):
            raise OSError(f"another writer made version {state['version']} of {self.folder}")
        self.state = state

    def _next(self) -> dict:
        return {**self.state, "version": self.state["version"] + 1}

    def _write(self, df: DataFrame, name: str, state: dict) -> str:
        path = f"{self.folder}/{name}-{state['version']}"
        df.write.mode("overwrite").parquet(path)  # over what a change that failed may have left
        return path

    def _table(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def holdings(self, state: dict | None = None) -> DataFrame:
        """``key``, ``doc`` of all live documents; a pair may come once per version."""
        state = state or self.state
        rows = self.spark.createDataFrame([], HOLDINGS + ", version int")
        for version, path in state["holdings"]:
            rows = rows.union(self._table(path, HOLDINGS).withColumn("version", F.lit(version)))
        for version, path in state["gone"]:
            away = self._table(path, "away long")
            rows = rows.join(away, F.col("doc").eqNullSafe(F.col("away")) & (F.col("version") < version), "left_anti")
        return rows.select("key", "doc")

    def refs(self) -> DataFrame:
        """``key``, ``documents`` (at least two), ``keeper`` (the smallest one)."""
        return self._table(self.state["refs"], REFS)

    def filters(self) -> DataFrame:
        return self._table(self.state["filters"], FILTERS)

    def _limit(self) -> int:
        return max(self.state["rows"] // HOT, 1000)

    def _recounted(self, state: dict, keys: DataFrame) -> DataFrame:
        """``counted`` for some keys (distinct), from the holdings of ``state``."""
        before = keys.join(self.refs().select("key", "documents"), "key", "left")
        sized = before.select("key", F.coalesce("documents", F.lit(1)).alias("documents"))
        return counted(join_keys(self.holdings(state), sized, self._limit()).select("key", "doc"))

    # Changes

    def insert(self, docs: DataFrame) -> None:
        """Add the lines of ``doc_id``, ``text``. A document that is there already then holds its old and new lines."""
        state = self._next()
        state["shards"] = state["shards"] or bucket_count(docs)
        path = self._write(holdings(docs), "holdings", state)
        state["holdings"] = [*state["holdings"], [state["version"], path]]
        batch = written(counted(self._table(path, HOLDINGS)), "batch")
        refs, new = batch.filter("documents > 1"), batch.select("key")
        if self.state["filters"]:
            known = written(self._ask(batch.select("key")), "known")
            held = written(self._recounted(self.state, known), "held").select("key")  # without the collisions
            again = self._recounted(state, held).filter("documents > 1")
            refs = self.refs().join(held, "key", "left_anti").union(refs.join(held, "key", "left_anti")).union(again)
            new = new.join(held, "key", "left_anti")
        state["refs"] = self._write(refs, "refs", state)
        state["filters"] = self._write(self._change(state, new.withColumn("add", F.lit(True))), "filters", state)
        state["rows"] = state["rows"] + self._table(path, HOLDINGS).count()
        self._commit(state)

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents of ``doc_id``. Unknown ids change nothing; a null means the document without an id."""
        state = self._next()
        path = self._write(ids.select(F.col("doc_id").cast("long").alias("away")).distinct(), "gone", state)
        state["gone"] = [*state["gone"], [state["version"], path]]
        away = self._table(path, "away long")
        lost = self.holdings().join(away, F.col("doc").eqNullSafe(F.col("away")), "left_semi")
        keys = written(lost.select("key").distinct(), "lost")
        left = written(self._recounted(state, keys), "left")
        state["refs"] = self._write(self.refs().join(keys, "key", "left_anti").union(left.filter("documents > 1")), "refs", state)
        unheld = keys.join(left, "key", "left_anti").withColumn("add", F.lit(False))
        state["filters"] = self._write(self._change(state, unheld), "filters", state)
        self._commit(state)

    def _sharded(self, keys: DataFrame, state: dict):
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(state["shards"])).cast("int")).groupBy("shard")

    def _ask(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters know: all that are held, and few others."""

        def ask(rows: pa.Table, kept: pa.Table) -> pa.Table:
            rows = rows.select(["key"])
            return rows.filter(pa.array(_filter_of(kept).contains(fingerprints(rows["key"].to_pylist()))))

        return self._sharded(keys, self.state).cogroup(self.filters().groupBy("shard")).applyInArrow(ask, "key binary")

    def _change(self, state: dict, keys: DataFrame) -> DataFrame:
        """The filters with distinct new keys (``add``) added and others, which nobody holds any more, taken out."""
        fields = pa.schema([("shard", pa.int32()), ("buckets", pa.binary()), ("stash", pa.binary())])

        def change(rows: pa.Table, kept: pa.Table) -> pa.Table:
            table = _filter_of(kept)
            prints = fingerprints(rows["key"].to_pylist())
            add = rows["add"].to_numpy().astype(bool)
            table.insert(prints[add])
            table.remove(prints[~add])
            shard = (rows if rows.num_rows else kept)["shard"][0]
            columns = [[shard.as_py()], [table.table.tobytes()], [table.stash.tobytes()]]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        return self._sharded(keys, state).cogroup(self.filters().groupBy("shard")).applyInArrow(change, FILTERS)

    # Results

    def clean(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` of every row of ``doc_id``, ``text``.

        Lines whose key at least two documents of the index hold go, except in the smallest of those documents.
        Others stay, joined by line feeds. Texts are packed in shards, and a shard asks for each of its keys once.
        """
        shards = pack(docs)

        def texts(shard: Shard) -> Iterator[list[bytes]]:
            for lo, hi in zip(shard.starts[:-1], shard.starts[1:], strict=True):
                yield shard.data[lo:hi].tobytes().split(b"\n")

        def keys_of(shard: Shard) -> Iterator[pa.RecordBatch]:
            found = list({d for lines in texts(shard) for d in digests(lines).values()})
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.shard] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["shard", "key"]
            )

        def drop(shard: Shard, notes: pa.Table) -> Iterator[pa.RecordBatch]:
            keeper = dict(zip(notes["key"].to_pylist(), notes["keeper"].to_pylist(), strict=True))
            names = ["doc_id", "n_lines", "n_dropped", "kept"]
            rows = []
            for doc, lines in zip(shard.ids, texts(shard), strict=True):
                held = {k for k, d in digests(lines).items() if keeper.get(d, doc) != doc} if keeper else ()
                kept = [line for line in lines if line_key(line) not in held] if held else lines
                rows.append((doc, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        asked = per_shard(shards, keys_of, "shard long, key binary")
        notes = join_keys(asked, self.refs(), self._limit()).select("shard", "key", "keeper")
        return with_notes(shards, notes, drop, CLEANED)


def dedup_lines(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The lines of a whole table deduplicated: an index of it (in ``folder``, to be carried on), and what it leaves."""
    index = LineIndex(docs.sparkSession, folder)
    index.insert(docs)
    return index.clean(docs)
