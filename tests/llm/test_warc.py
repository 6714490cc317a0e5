"""Archives: an exact round trip, revisits, and random access through manifest and seek table."""

import hashlib

import zstandard

from pairloom.llm import warc
from pairloom.session import scratch_dir

LONG = "<p>ü漢\r\n\r\n" + "x" * 200
PAGES = [
    (5, "http://a/é b%20c", LONG), (3, "http://b", LONG), (3, "http://b", LONG), (None, None, LONG), (9, "http://c", "short"),
    (8, "http://d", "short"), (8, "http://d", "short"), (1, None, None), (2, "", ""), (4, "u\nv", "y" * 100), (6, "w", "y" * 99),
    (7, "big", "z" * 700_000), (-1, "w2", "y" * 99), (None, "only", "n" * 150),
]


def expected(pages):
    order = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")
    out, seen = [], {}
    for page, _, html in sorted(pages, key=order):
        raw = (html or "").encode()
        first = seen.setdefault(raw, page) if len(raw) >= 100 and raw in seen else None
        new = not (len(raw) >= 100 and raw in seen)
        seen.setdefault(raw, page)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if new else "revisit", first))
    return out


def frame_of(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark):
    got = warc.round_trip(spark, frame_of(spark, PAGES)).drop("record_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(PAGES), key=repr)
    assert warc.round_trip(spark, frame_of(spark, PAGES).limit(0)).count() == 0


def test_one_record_from_its_frame(spark):
    base = scratch_dir(spark, "warc")
    rows = warc.records(frame_of(spark, PAGES))
    manifest = warc.write_archive(rows, base)
    assert manifest.select("record_id").distinct().count() == len(PAGES)
    want = {r.record_id: r for r in rows.collect()}
    for r in warc.read_archive(manifest.filter("offset > 0"), base).collect():
        assert (r.url, r.refers_to, r.digest, r.bytes, r.record_type) == tuple(
            want[r.record_id][c] for c in ("url", "refers_to", "digest", "bytes", "record_type")
        )
        assert r.record_type == "revisit" or r.payload == bytes(want[r.record_id].payload)
    # A bundle is a plain Zstandard file too: frames in a row, the seek table skipped.
    name = manifest.first().bundle
    raw = open(f"{base.removeprefix('file://')}/{name}", "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == manifest.filter(manifest.bundle == name).count()
