"""WARC archives in seekable Zstandard bundles.

A bundle is one file of independent frames, each a few hundred kilobytes of whole records, with a seek
table in a skippable frame at its end (the seekable format of the Zstandard project). A manifest, a
Spark table, maps each record identifier to bundle, frame and offset inside the frame, so one
record is read by unpacking one frame. Bundles are written by tasks under names of their own;
only those that the manifest of a successful attempt names are ever read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.components import written
from pairloom.session import scratch_dir

LEAST = 100  # bytes from which on an equal payload is a revisit
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
FRAMES_PER_TASK = 64
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format: the skippable frame's magic number, the footer's, and its layout.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<II"), struct.Struct("<IBI")
# Fixed value: the profile of a revisit whose payload is equal.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "record_id string, bundle string, frame int, offset int, size int"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """A skippable frame with (compressed, plain) sizes of all frames, read from its end."""
    body = b"".join(ENTRY.pack(*sizes) for sizes in frames) + FOOTER.pack(len(frames), 0, SEEKABLE)
    return ENTRY.pack(SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile, size: int) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame."""
    count, _, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    raw = file.read_at(count * ENTRY.size, size - FOOTER.size - count * ENTRY.size)
    frames, at = [], 0
    for packed, _ in ENTRY.iter_unpack(raw):
        frames.append((at, packed))
        at += packed
    return frames


def _lines(first: str, fields: dict[str, object]) -> bytes:
    shown = [first, *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return ("\r\n".join(shown) + "\r\n\r\n").encode()


def record(row: dict) -> bytes:
    """One WARC/1.1 record: the block is an HTTP response, without its body for a revisit."""
    body = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    url = None if row["url"] is None else quote(row["url"], safe=":/?#[]@!$&'()*+,;=")
    http = _lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": row["bytes"]})
    block = http if revisit else http + body
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<{row['refers_to']}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    return _lines("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where it says")
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, _fields(http), body


class _Bundle:
    """One open bundle file of a task."""

    def __init__(self, base: str) -> None:
        self.system, path = pafs.FileSystem.from_uri(base)
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        self.file = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.size = self.filled = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and offset of a record."""
        if self.filled and self.filled + len(raw) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.filled)
        self.waiting.append(raw)
        self.filled += len(raw)
        return place

    def flush(self) -> None:
        plain = b"".join(self.waiting)
        packed = zstandard.ZstdCompressor(level=6).compress(plain)
        self.file.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.size += len(packed)
        self.waiting, self.filled = [], 0

    def close(self) -> None:
        if self.waiting:
            self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()


def _write(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    bundle = None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if bundle is None or bundle.size >= BUNDLE_BYTES:
                if bundle is not None:
                    bundle.close()
                bundle = _Bundle(base)
            raw = record(row)
            rows.append((row["record_id"], bundle.name, *bundle.add(raw), len(raw)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["record_id", "bundle", "frame", "offset", "size"]
        )
    if bundle is not None:
        bundle.close()


def _named(page: str, *rest: Column | str) -> Column:
    """urn:page:<page_id or none>:<rest>"""
    parts = [F.lit("urn:page"), F.coalesce(F.col(page).cast("string"), F.lit("none")), *rest]
    return F.concat_ws(":", *parts)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``record_id``, ``record_type``, ``refers_to``, ``url``, ``digest``, ``bytes``, ``payload`` for each row of ``pages``.

    Of rows whose payloads (html in UTF-8, null: empty) are equal and have at least ``least`` bytes, the one with the
    smallest page_id is the response (null ids last; of equal ids the smallest url); the others revisit
    it. A payload crosses the network once per task that holds it, and revisits carry none. The number
    of revisits of a payload is not bounded, but they are rows of their own, never a group.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.sha2(html, 256).alias("digest"),
        html.alias("html"),
    )
    keys = ["page_id", "url", "bytes", "digest"]
    order = F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url")
    large = base.filter(F.col("bytes") >= least)
    copy = F.concat_ws(":", F.xxhash64("url").cast("string"), F.col("k").cast("string"))
    nothing = F.lit(None).cast("string")
    row = ["record_id", "record_type", "refers_to", "url", "digest", "bytes", "payload"]

    small = base.filter(F.col("bytes") < least).groupBy(*keys, "html").count()
    small = small.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("count")))).select(
        _named("page_id", "digest", copy).alias("record_id"), F.lit("response").alias("record_type"),
        nothing.alias("refers_to"), "url", "digest", "bytes", F.col("html").cast("binary").alias("payload"),
    )
    responses = large.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "bytes", "html"), order).alias("r"))
    responses = responses.select("digest", "r.*").select(
        _named("page_id", "digest").alias("record_id"), F.lit("response").alias("record_type"),
        nothing.alias("refers_to"), "url", "digest", "bytes", F.col("html").cast("binary").alias("payload"),
    )
    first = large.groupBy("digest").agg(F.min(order).alias("first"))
    copies = large.groupBy(*keys).count().join(first, "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    more = F.col("count") - F.when(is_first, 1).otherwise(0)
    revisits = (
        copies.filter(more > 0)
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), more)))
        .select(
            _named("page_id", "digest", copy).alias("record_id"), F.lit("revisit").alias("record_type"),
            _named("first.page_id", "digest").alias("refers_to"), "url", "digest", "bytes",
            F.lit(None).cast("binary").alias("payload"),
        )
    )
    return small.select(*row).union(responses.select(*row)).union(revisits.select(*row))


def write_archive(rows: DataFrame, base: str) -> DataFrame:
    """Write bundles below the folder ``base`` (which all executors see) and return their manifest, written too."""
    system, path = pafs.FileSystem.from_uri(base)
    system.create_dir(path, recursive=True)
    return written(rows.mapInArrow(lambda batches: _write(batches, base), MANIFEST), "manifest")


READ = (
    "record_id string, record_type string, refers_to string, url string, digest string, bytes long, payload binary"
)
READ_TYPES = [pa.string()] * 5 + [pa.int64(), pa.binary()]
READ_NAMES = [c.split()[0] for c in READ.split(", ")]


def read_archive(manifest: DataFrame, base: str, payloads: bool = True) -> DataFrame:
    """The records that a manifest names. Any part of a manifest will do; only its frames are unpacked.

    The payload of a response is held against its digest; a wrong one stops the job.
    """

    def read(rows: pa.Table) -> pa.Table:
        system, path = pafs.FileSystem.from_uri(base)
        name = f"{path}/{rows['bundle'][0].as_py()}"
        out = []
        with system.open_input_file(name) as file:
            frames = read_seek_table(file, file.size())
            opened, plain = None, b""
            for row in rows.sort_by([("frame", "ascending"), ("offset", "ascending")]).to_pylist():
                if row["frame"] != opened:
                    opened = row["frame"]
                    at, size = frames[opened]
                    plain = zstandard.ZstdDecompressor().decompress(file.read_at(size, at))
                fields, http, body = parse(plain[row["offset"] : row["offset"] + row["size"]])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"record {row['record_id']} in {name} does not match its digest")
                refers = fields.get("WARC-Refers-To")
                target = fields.get("WARC-Target-URI")
                out.append((
                    fields["WARC-Record-ID"].strip("<>"), kind, refers and refers.strip("<>"), target and unquote(target),
                    digest, int(http["Content-Length"]), body if payloads and kind == "response" else None,
                ))
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, READ_TYPES, strict=True)], names=READ_NAMES)

    blocks = manifest.withColumn("block", F.floor(F.col("frame") / FRAMES_PER_TASK))
    return blocks.groupBy("bundle", "block").applyInArrow(read, READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, read it back, and name the pages of its records."""
    base = scratch_dir(spark, "warc")
    manifest = write_archive(records(pages), base)
    found = read_archive(manifest, base, payloads=False)
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS bigint)")
    return found.select(
        page("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"), "record_id",
    )
