"""The positional index against brute force: windows, proximity, several blocks, null and repeated rows."""

import hashlib
import random
import re

from pairloom.llm import decontaminate as dc


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, other in items:
            v = words(other)
            k = min(window, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    if item is not None:
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def tables(seed):
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(["the", "a", "Zwölf", "x1", f"r{rng.randrange(40)}"]) for _ in range(n))
    items = [(i, draw(rng.randrange(1, 30))) for i in range(12)] + [(3, draw(14)), (None, draw(12)), (77, None), (78, "!?"), (9, "r1 r2")]
    docs = [(None, None), (1, ""), (2, "..."), (3, "the")]
    for i in range(60):
        text = draw(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            other = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(other) + 1)
            text += rng.choice([" ", "-", "\n", " q "]) + ", ".join(other[at:]).upper() + " " + draw(3)
        docs.append((i % 25, text))
    return docs + docs[:9], items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, item_id string").repartition(4)
    return d, spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    docs, items = tables(1)
    found = dc.digest(dc.decontaminate(*frames(spark, docs, items)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(docs, items), key=repr)


def test_several_blocks_give_the_same(spark, monkeypatch):
    docs, items = tables(2)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    found = dc.digest(dc.decontaminate(*frames(spark, docs, items)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(docs, items), key=repr)


def test_empty_tables(spark):
    docs, items = frames(spark, *tables(3))
    assert dc.decontaminate(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in dc.decontaminate(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x y z q beta gamma delta"), (4, "beta alpha")]
    found = dc.decontaminate(*frames(spark, docs, [(5, "alpha beta gamma delta")]), slop=1)
    got = {r.id: [(m.start, m.exact) for m in r.matches] for r in found.collect()}
    assert got[1] == [(0, True)] and len(got[2]) == 1 and not got[2][0][1] and got[3] == [] and got[4] == []


def test_blocks_are_bounded_and_cut_no_window(spark, monkeypatch):
    from pairloom.llm import decontaminate as dc

    long = " ".join(f"w{i}" for i in range(95))
    items = [(1, "same row of words " * 3)] * 200 + [(2, long)] + [(i, f"a{i} b{i} c{i}") for i in range(3, 40)] + [(50, None), (51, "--")]
    docs = [(1, "x " + long), (2, "w28 w29 w30 w31"), (3, "a7 b7 c7"), (4, "a7 x b7 c7"), (5, "nothing"), (6, None), (7, "b9 c9")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = {s: sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(d, b, 4, s).collect()) for s in (0, 1)}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 30)
    blocks, count = dc._blocks(b, 4)
    sizes = {}
    for r in blocks.collect():
        sizes[r.block] = sizes.get(r.block, 0) + len(r.text.split())
    assert count > 2 and max(sizes.values()) < 60
    monkeypatch.setattr(dc, "BLOCK_WORDS", 80)
    for slop, want in whole.items():
        got = sorted((r.id, r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(d, b, 4, slop).collect())
        assert got == want
