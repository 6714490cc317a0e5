"""Packed shards of documents, and names that are sorted across all shards.

A shard is one row: a few megabytes of whole texts, compressed, with their ids. The table is
written once, so (shard, slot) names a document for good, also if ids are null or repeat. Work on
text runs per shard in numpy. What must meet across shards travels as *names* (64-bit values),
cut into buckets by value: every bucket is sorted on its own and answers each shard with a few
bits per name, in the order in which the shard sent them. A shard sends each name at most once,
so a name that all documents hold costs one entry per shard and no task sees its documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import written
from pairloom.session import shuffle_width

SHARD_BYTES = 2 << 20
MAX_SLOTS = 1 << 16  # rows of a shard, so that shard * MAX_SLOTS + slot is one long
SHARD_SCHEMA = "shard long, ids array<long>, sizes array<int>, blob binary"
NAMES_SCHEMA = "bucket int, shard long, n long, names binary, extra binary"
NOTES_SCHEMA = "shard long, kind int, bucket int, bits binary"


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null mask of a string column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at, column.is_null().to_numpy(zero_copy_only=False)


def _pack(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        raw, at, null = _flat(batch.column(1))
        ids = batch.column(0)
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(at, at[first] + target, "right")) - 1)
            last = min(last, first + MAX_SLOTS)
            sizes = np.where(null[first:last], -1, np.diff(at[first : last + 1])).astype(np.int32)
            # Null texts have no bytes of their own in Arrow's layout from Spark.
            blob = squeeze(raw[at[first] : at[last]].tobytes(), 3)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids.slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([blob], pa.binary()),
                ],
                names=["shard", "ids", "sizes", "blob"],
            )
            number += 1
            first = last


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = SHARD_BYTES) -> DataFrame:
    """Documents as a written table of shards. A text longer than ``target`` has a shard of its own."""
    pairs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    packed = pairs.mapInArrow(lambda batches: _pack(batches, target), SHARD_SCHEMA)
    return written(packed, "shards", "uncompressed")


class Shard:
    """One shard in memory: ``data`` (bytes), ``sizes`` (null: 0), ``starts``, ``ids``."""

    def __init__(self, shard: int, ids: list, sizes: np.ndarray, blob: bytes) -> None:
        self.shard = shard
        self.ids = ids
        self.null = sizes < 0
        self.sizes = np.maximum(sizes, 0).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.data = np.frombuffer(expand(blob), np.uint8)

    def __len__(self) -> int:
        return len(self.sizes)


def shards_of(table: pa.Table | pa.RecordBatch) -> Iterator[Shard]:
    for i in range(table.num_rows):
        row = {name: table.column(name)[i] for name in ("shard", "ids", "sizes", "blob")}
        sizes = np.asarray(row["sizes"].as_py(), dtype=np.int64)
        yield Shard(row["shard"].as_py(), row["ids"].as_py(), sizes, row["blob"].as_py())


def pack_planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpack_planes(packed: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, byte by byte of equal weight."""
    return pack_planes(np.diff(values, prepend=np.uint64(0)).astype("<u8"))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(packed, "<u8"), dtype=np.uint64)


def bucket_of(names: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Equal ranges of name values: the buckets of sorted names are sorted."""
    return ((names >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def send_names(shard: int, names: np.ndarray, extra: np.ndarray | None, buckets: int, bits: int) -> list[tuple]:
    """Rows of NAMES_SCHEMA for sorted names; ``extra`` goes along, entry by entry."""
    edges = np.searchsorted(bucket_of(names, buckets, bits), np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        lo, hi = edges[b], edges[b + 1]
        if lo < hi:
            more = b"" if extra is None else squeeze(extra[lo:hi].tobytes())
            rows.append((b, shard, int(hi - lo), pack_sorted(names[lo:hi]), more))
    return rows


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


NAMES_ARROW = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("names", pa.binary()), ("extra", pa.binary())]
)
NOTES_ARROW = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])

Judge = Callable[[np.ndarray, list, np.ndarray], np.ndarray]


def answer(names: DataFrame, kind: int, judge: Judge, dtype: str = "u1") -> DataFrame:
    """Sort every bucket and send each shard one value (a byte, or ``dtype``) per name it sent (NOTES_SCHEMA).

    ``judge(names, extras, owner)`` sees a bucket: all names, the shards' extra bytes and the index
    of the sender of each name (senders in order of their shard numbers).
    """

    def sort_bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        parts = [unpack_sorted(x) for x in table["names"].to_pylist()]
        extras = [expand(x) if x else b"" for x in table["extra"].to_pylist()]
        counts = [len(x) for x in parts]
        owner = np.repeat(np.arange(len(parts)), counts)
        out = judge(np.concatenate(parts), extras, owner).astype(dtype)
        cuts = np.cumsum(counts)[:-1]
        bucket = table["bucket"][0].as_py()
        rows = [
            (shard, kind, bucket, squeeze(bits.tobytes()))
            for shard, bits in zip(table["shard"].to_pylist(), np.split(out, cuts), strict=True)
        ]
        return pa.Table.from_batches([rows_batch(rows, NOTES_ARROW)])

    return names.groupBy("bucket").applyInArrow(sort_bucket, NOTES_SCHEMA)


def notes_of(table: pa.Table, kind: int, dtype: str = "u1") -> np.ndarray:
    """The values that ``answer`` sent to a shard, in the order of its sorted names."""
    mine = table.filter(pc.equal(table["kind"], kind)).sort_by("bucket")
    parts = [np.frombuffer(expand(x), dtype) for x in mine["bits"].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def with_notes(shards: DataFrame, notes: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(shard, notes table)`` yields record batches for each shard and what was sent to it."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [b for s in shards_of(left) for b in work(s, right)]
        return pa.Table.from_batches(out)

    return shards.groupBy("shard").cogroup(notes.groupBy("shard")).applyInArrow(both, schema)


def per_shard(shards: DataFrame, work: Callable, schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards_of(batch):
                yield from work(shard)

    return shards.mapInArrow(each, schema)


def bucket_count(df: DataFrame) -> int:
    """Buckets grow with the session's shuffle width, which grows with the data."""
    return 4 * shuffle_width(df.sparkSession)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
