"""Line dedup against a plain recomputation; insertions and deletions that leave no trace."""

import numpy as np
import pytest

from pairloom.llm.line_index import CuckooFilter, LineIndex, dedup_lines

STRIP, UPPER = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(STRIP).translate(UPPER)


def brute(held, rows):
    """``held``: all documents of the index, ``rows``: those to clean."""
    docs = {}
    for i, text in held:
        docs.setdefault(i, set()).update(k for k in map(key, (text or "").split("\n")) if len(k) >= 10)
    keys = {}
    for i, found in docs.items():
        for k in found:
            keys.setdefault(k, []).append(i)
    least = {k: min(v, key=lambda i: (i is None, i)) for k, v in keys.items() if len(v) > 1}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if least.get(key(line), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, key string").repartition(3)


ODD = [
    (1, "A shared header line\nonly here, in one\n  short \nA SHARED HEADER LINE\t"), (2, " a shared header line \nÄ shared footer line"),
    (3, "ä shared footer line\nÄ shared footer line\n\n"), (5, None), (6, ""), (7, "\n"), (None, "a shared header line\nnobody else has it"),
    (None, "nobody else has it"), (8, "äöüäöüäöü\näöüäöüäöüä"), (9, "äöüäöüäöü\näöüäöüäöüä"), (4, "repeated row here"), (4, "repeated row here"),
    (10, "\x0ba shared header line\x0c\r"), (11, "nul \0 inside a line"), (12, "nul \0 inside a line"), (-3, "repeated row here"),
]


def random_rows(rng, ids):
    pool = [f"line number {i} of the pool" for i in range(60)] + ["short"] * 5
    return [(i, "\n".join(rng.choice(pool, rng.integers(0, 12)).tolist())) for i in ids]


def result(df):
    assert df.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark):
    rows = ODD + random_rows(np.random.default_rng(3), range(100, 300)) + [(400, "x" * 200_000 + "\n" + "a shared header line\n" * 30_000)]
    assert result(dedup_lines(frame(spark, rows))) == brute(rows, rows)
    assert result(dedup_lines(frame(spark, []))) == []


def state(index):
    """What the index says, apart from the order of slots in its filters."""
    refs = sorted(map(tuple, index.refs().collect()), key=repr)
    prints = []
    for r in index.filters().collect():
        table = CuckooFilter.load(bytes(r.buckets), bytes(r.stash))
        prints += sorted([*table.table[table.table != 0].tolist(), *table.stash.tolist()])
    return refs, sorted(prints)


def test_insertions_and_deletions(spark, tmp_path):
    rng = np.random.default_rng(4)
    one, two, three = ODD, random_rows(rng, range(20, 60)), random_rows(rng, range(50, 90))
    index = LineIndex(spark, str(tmp_path / "index"), shards=4)
    index.insert(frame(spark, one))
    assert result(index.clean(frame(spark, one))) == brute(one, one)
    before = state(index)
    index.insert(frame(spark, two))
    index = LineIndex(spark, str(tmp_path / "index"))  # opened again from its folder
    both = one + two
    assert result(index.clean(frame(spark, both))) == brute(both, both)
    index.insert(frame(spark, three))
    every = both + three
    assert result(index.clean(frame(spark, every))) == brute(every, every)
    # The smallest holders go: their lines move to the next document.
    gone = {1, None, 20, 21, 55, 999}
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [(i, t) for i, t in every if i not in gone]
    assert result(index.clean(frame(spark, left))) == brute(left, left)
    index.insert(frame(spark, [r for r in one if r[0] in gone]))
    index.delete(spark.createDataFrame([(i,) for i, _ in two + three], "doc_id long"))
    assert state(index) == before
    assert result(index.clean(frame(spark, one))) == brute(one, one)
    index.delete(spark.createDataFrame([(i,) for i, _ in one], "doc_id long"))
    assert state(index) == ([], [])


def test_filter_collisions_cost_no_result(spark, tmp_path, monkeypatch):
    # Two different fingerprints for all keys: nearly every answer of the filters is a collision.
    import pairloom.llm.line_index as li

    monkeypatch.setattr(li, "fingerprints", lambda keys: np.array([1 + k[0] % 2 for k in keys], np.uint32))
    rows = ODD + random_rows(np.random.default_rng(5), range(20, 50))
    index = LineIndex(spark, str(tmp_path / "index"), shards=2)
    for part in (rows[:20], rows[20:35], rows[35:]):
        index.insert(frame(spark, part))
    assert result(index.clean(frame(spark, rows))) == brute(rows, rows)
    gone = [i for i, _ in rows[10:30]]
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert result(index.clean(frame(spark, left))) == brute(left, left)


def test_filter(spark):
    rng = np.random.default_rng(6)
    prints = np.unique(rng.integers(1, 1 << 32, 60_000, dtype=np.uint32))
    rng.shuffle(prints)
    table = CuckooFilter()
    for part in np.split(prints[:50_000], 7_000 * np.arange(1, 8)):
        table.insert(part)
    assert table.contains(prints[:50_000]).all() and not table.contains(prints[50_000:]).any() and len(table) == 50_000
    table = CuckooFilter.load(table.table.tobytes(), table.stash.tobytes())
    table.remove(prints[:30_000])
    assert table.contains(prints[30_000:50_000]).all() and not table.contains(prints[:30_000]).any() and len(table) == 20_000
    many = np.repeat(prints[:5], [1, 2, 8, 9, 40])  # more equal ones than two buckets hold
    table.insert(many)
    assert len(table) == 20_060
    table.remove(many[:-1])
    assert table.contains(prints[4:5]).all() and not table.contains(prints[:4]).any()
    table.remove(many[-1:])
    assert not table.contains(prints[4:5]).any() and table.contains(prints[30_000:50_000]).all()
    table.remove(prints[30_000:50_000])
    assert len(table) == 0


def test_a_failed_change_leaves_the_index(spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"), shards=2)
    index.insert(frame(spark, ODD))
    broken = frame(spark, ODD).selectExpr("doc_id", "if(doc_id = 8, raise_error('lost'), text) AS text")
    with pytest.raises(Exception, match="lost"):
        index.insert(broken)
    again = LineIndex(spark, str(tmp_path / "index"))
    assert again.state["version"] == 1 and result(again.clean(frame(spark, ODD))) == brute(ODD, ODD)
    again.insert(frame(spark, [(500, "a line of a new document")]))
    assert LineIndex(spark, str(tmp_path / "index")).state["version"] == 2
