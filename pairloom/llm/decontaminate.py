"""Benchmark decontamination with a stored positional index.

The index holds, per shard of documents, the positions of every term that some benchmark item uses
(a term of no item cannot be part of a match). It is partitioned by document: a shard's lists meet
only each other, so nothing is shuffled and a common word is no hot spot. A search takes the terms
of a window from the rarest list of the shard on, shifts each list by the term's offset and
intersects. With ``slop`` a term may stand up to so many words off its place.

Benchmark items are split into blocks of bounded size; each block is one pass over the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm import shards as sh
from pairloom.llm.components import written
from pairloom.llm.words import ALNUM, LOWER, find_words, hash_words

WINDOW = 10
GAP = 64  # free places between documents, more than a window and its slop
BLOCK_WORDS = 1_000_000  # of benchmark text in one pass
MAX_TERMS = 2_000_000  # with more distinct terms the index keeps all terms

INDEX = "shard long, ids array<long>, first array<int>, terms binary, counts binary, positions binary"
INDEX_ARROW = pa.schema(
    [("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())),
     ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())]
)


def terms_of(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the number of the first word of each text."""
    data = LOWER[text]
    begin, end, first = find_words(data, starts, ALNUM)
    return hash_words(data, begin, end), first


def build_index(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """Postings of the terms in ``vocabulary`` (sorted hashes; None: all terms), as a written table.

    Word w of the document in slot s has the position w + s * GAP, so no phrase crosses documents.
    """

    def index(shard: sh.Shard) -> Iterator[pa.RecordBatch]:
        terms, first = terms_of(shard.data, shard.starts)
        place = np.arange(len(terms)) + np.repeat(np.arange(len(shard)), np.diff(first)) * GAP
        if vocabulary is not None and len(terms):
            at = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
            known = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)
            terms, place = terms[known], place[known]
        order = np.argsort(terms, kind="stable")
        distinct, counts = np.unique(terms[order], return_counts=True)
        gaps = np.diff(place[order], prepend=0).astype("<i4")
        columns = (distinct.tobytes(), counts.astype("<i4").tobytes(), gaps.tobytes())
        row = (shard.shard, shard.ids, first.tolist(), *(sh.squeeze(c) for c in columns))
        yield sh.rows_batch([row], INDEX_ARROW)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sh._pack(source, sh.SHARD_BYTES):
            for shard in sh.shards_of(batch):
                yield from index(shard)

    pairs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return written(pairs.mapInArrow(batches, INDEX), "index")


class Windows:
    """The windows of some items: term numbers by offset, and the item of each window."""

    def __init__(self, items: list, texts: list, size: int) -> None:
        data = [(t or "").encode() for t in texts]
        starts = np.cumsum([0, *map(len, data)])
        terms, first = terms_of(np.frombuffer(b"".join(data), np.uint8), starts)
        self.vocabulary, number = np.unique(terms, return_inverse=True)
        number = number.reshape(-1)
        count = np.diff(first)
        self.size = np.minimum(count, size)
        windows = np.where(count > 0, count - self.size + 1, 0)
        self.item = np.repeat(np.arange(len(items)), windows)
        begin = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin += np.repeat(first[:-1], windows)
        self.length = self.size[self.item]
        offsets = np.arange(size)
        at = np.minimum(begin[:, None] + offsets[None, :], max(len(number) - 1, 0))
        self.term = number[at] if len(number) else np.zeros((0, size), np.int64)
        self.inside = offsets[None, :] < self.length[:, None]
        self.items = items


HITS = (
    "node long, id long, n_words long, n_hit long, items array<string>, "
    "matches array<struct<item:string,start:int,stop:int,exact:boolean>>"
)
MATCH = pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("exact", pa.bool_())])
HITS_ARROW = pa.schema(
    [("node", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
     ("items", pa.list_(pa.string())), ("matches", pa.list_(MATCH))]
)


def _starts(lists: list[np.ndarray], offsets: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may start (by its rarest term), and the words it then spans beyond its length."""
    found = lists[0] - offsets[0]
    off = np.zeros(len(found), np.int64)
    for places, offset in zip(lists[1:], offsets[1:], strict=True):
        if not len(found):
            break
        want = found + offset
        right = np.searchsorted(places, want)
        after = places[np.minimum(right, len(places) - 1)]
        before = places[np.maximum(right - 1, 0)]
        distance = np.minimum(np.abs(after - want), np.abs(before - want))
        keep = distance <= slop
        found, off = found[keep], np.maximum(off[keep], distance[keep])
    return found, off


def _search(row: dict, windows: Windows, slop: int) -> Iterator[tuple]:
    """One row of HITS per document of an index row."""
    first = np.asarray(row["first"], np.int64)
    terms = np.frombuffer(sh.expand(row["terms"]), np.uint64)
    counts = np.frombuffer(sh.expand(row["counts"]), "<i4").astype(np.int64)
    positions = np.cumsum(np.frombuffer(sh.expand(row["positions"]), "<i4").astype(np.int64))
    ends = np.cumsum(counts)
    docs = len(row["ids"])
    matches: list[list] = [[] for _ in range(docs)]
    hit = np.zeros(int(first[-1]) + docs * GAP + GAP, bool)
    if len(windows.vocabulary) and len(terms):
        at = np.minimum(np.searchsorted(terms, windows.vocabulary), len(terms) - 1)
        length = np.where(terms[at] == windows.vocabulary, counts[at], 0)
        per_term = np.where(windows.inside, length[windows.term], np.iinfo(np.int64).max)
        for w in np.flatnonzero((per_term > 0).all(axis=1)):
            rare = np.argsort(per_term[w], kind="stable")[: windows.length[w]]
            numbers = at[windows.term[w, rare]]
            lists = [positions[ends[t] - counts[t] : ends[t]] for t in numbers]
            found, off = _starts(lists, rare, slop)
            size = int(windows.length[w])
            for start, distance in zip(found.tolist(), off.tolist(), strict=True):
                # Document s holds the positions first[s] + s * GAP and on.
                slot = int(np.searchsorted(first + np.arange(docs + 1) * GAP, start + size // 2, "right")) - 1
                origin = int(first[slot]) + slot * GAP
                hit[max(start, origin) : start + size] = True
                matches[slot].append((windows.items[windows.item[w]], start - origin, start - origin + size, not distance))
    for slot in range(docs):
        origin, n = int(first[slot]) + slot * GAP, int(first[slot + 1] - first[slot])
        found = matches[slot]
        items = sorted({str(m[0]) for m in found if m[0] is not None})
        spans = [
            {"item": None if m[0] is None else str(m[0]), "start": m[1], "stop": m[2], "exact": m[3]} for m in found
        ]
        node = row["shard"] * sh.MAX_SLOTS + slot
        yield node, row["ids"][slot], n, int(hit[origin : origin + n].sum()), items, spans


def search_index(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                yield sh.rows_batch(list(_search(row, windows, slop)), HITS_ARROW)

    return index.mapInArrow(search, HITS)


def _blocks(benchmark: DataFrame, window: int) -> tuple[DataFrame, int]:
    """Different items with a block number, and the number of blocks; a block has less than 2 * BLOCK_WORDS words.

    Items beyond BLOCK_WORDS words are cut into pieces that overlap by ``window - 1`` words, so each window is in one.
    Blocks are cut by running sums of words: sums of hash buckets give offsets, rows are summed inside their bucket.
    """
    found, limit = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", max(BLOCK_WORDS, window)
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(found)), F.lit(0)).cast("long")
    step = limit - window + 1
    starts = F.sequence(F.lit(1), F.greatest(F.col("words") - F.lit(window - 1), F.lit(1)).cast("int"), F.lit(step))
    every = F.regexp_extract_all(F.col("text"), F.lit(found), F.lit(0))
    piece = lambda s: F.array_join(F.slice(every, s, limit), " ")
    texts = F.when(F.col("words") <= limit, F.array("text")).otherwise(F.transform(starts, piece))
    pieces = benchmark.distinct().withColumn("words", words).filter("words > 0").select("item_id", F.explode(texts).alias("text"))
    pieces = pieces.distinct().withColumn("words", F.regexp_count(F.col("text"), F.lit(found)).cast("long"))
    pieces = written(pieces.withColumn("h", F.xxhash64("item_id", "text")).withColumn("bucket", F.pmod("h", F.lit(1024))), "items")
    before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = pieces.groupBy("bucket").agg(F.sum("words").alias("words"))
    offsets = sums.select("bucket", before(Window.orderBy("bucket")).alias("offset"))
    inside = before(Window.partitionBy("bucket").orderBy("h", "item_id", "text"))
    placed = pieces.withColumn("inside", inside).join(offsets, "bucket")
    blocks = placed.select("item_id", "text", F.floor((F.col("offset") + F.col("inside")) / limit).alias("block"))
    last = blocks.agg(F.max("block")).first()[0]
    return blocks, (last or 0) + 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Words of ``docs`` inside any occurrence of a window of ``window`` consecutive item words.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. An item with fewer
    words, but at least one, is one window; a null or wordless text has none. Returns one row per input row:
    ``id``, ``n_words``, ``n_hit``, ``items`` (ids of the items with occurring windows, as sorted strings)
    and ``matches`` (item, first word, end, exact or by proximity). Items of one id count once; items
    with a null id mark words but are not listed. Ids of documents may be null or repeat.
    """
    if not 0 <= slop < GAP - window:
        raise ValueError(f"a window of {window} words leaves no room for a slop of {slop}")
    items, count = _blocks(benchmark.select("item_id", "text"), window)
    if count == 1:
        rows = items.select("item_id", "text").collect()  # less than 2 * BLOCK_WORDS words
        windows = Windows([r[0] for r in rows], [r[1] for r in rows], window)
        index = build_index(docs, windows.vocabulary if len(windows.vocabulary) <= MAX_TERMS else None)
        return search_index(index, windows, slop)
    index, parts = build_index(docs, None), []
    for block in range(count):
        rows = items.filter(F.col("block") == block).select("item_id", "text").collect()
        windows = Windows([r[0] for r in rows], [r[1] for r in rows], window)
        parts.append(written(search_index(index, windows, slop).filter("n_hit > 0"), "hits"))
    return _merge(index, parts)


def _merge(index: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Hits of several blocks, by document: words hit by two blocks count once."""
    empty = Windows([], [], WINDOW)
    base = search_index(index, empty).select("node", "id", "n_words")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    hits = hits.groupBy("node").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    inside = "filter(matches, m -> m.start < n_words AND m.stop > 0)"
    words = f"transform({inside}, m -> sequence(greatest(m.start, 0), least(m.stop, n_words) - 1))"
    return base.join(hits, "node", "left").select(
        "node",
        "id",
        "n_words",
        F.coalesce(F.expr(f"cast(size(array_distinct(flatten({words}))) as long)"), F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("matches", F.expr("slice(array(struct('' AS item, 0 AS start, 0 AS stop, true AS exact)), 1, 0)")).alias(
            "matches"
        ),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result by document: number of hit words and items, and a digest of the item ids."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
