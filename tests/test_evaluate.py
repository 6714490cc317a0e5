import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import evaluate as ev

SMOKE = [
    ("c1ccccc1", "c1cccnc1"),
    ("c1ccccc1O", "c1cnccc1O"),
    ("c1ccccc1F", "c1ccccc1F"),
    ("c1ccccc1C", "c1ncccc1C"),
]


def frame(spark, pairs):
    return spark.createDataFrame(
        [(i, t, p) for i, (t, p) in enumerate(pairs)], "pair_id int, target string, pred string"
    )


def bleu(pairs):
    match, total = Counter(), Counter()
    for t, p in pairs:
        for n in range(1, 5):
            a = Counter(t[i : i + n] for i in range(len(t) - n + 1))
            b = Counter(p[i : i + n] for i in range(len(p) - n + 1))
            match[n] += sum((a & b).values())
            total[n] += max(1, len(p) - n + 1)
    if any(match[n] == 0 for n in range(1, 5)):
        return 0.0
    r, c = sum(len(t) for t, _ in pairs), sum(len(p) for _, p in pairs)
    return (1 if c > r else math.exp(1 - r / c)) * math.exp(sum(math.log(match[n] / total[n]) / 4 for n in range(1, 5)))


def test_smoke_pairs(spark):
    df = frame(spark, SMOKE)
    assert sorted(r.lev for r in ev.edit_distance(df).collect()) == [0, 1, 1, 1]
    row = ev.exact_match(df).first()
    assert (row.n_pairs, row.n_exact, row.exact_match) == (4, 1, 0.25)
    summary = ev.pair_summary(df, "pair_id", lambda c: c != "").first()
    assert summary.mean_lev == 0.75 and summary.validity == 1.0
    assert summary.bleu == pytest.approx(bleu(SMOKE))


def test_bleu_against_counts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40)))
    pairs = [(word(), word()) for _ in range(60)] + [("abc", "ab"), ("", "aaaa"), ("aaaa", "")]
    row = ev.corpus_bleu(frame(spark, pairs), "pair_id").first()
    assert row.bleu == pytest.approx(bleu(pairs))


def test_bleu_edges(spark):
    same = [(t, t) for t, _ in SMOKE]
    assert ev.corpus_bleu(frame(spark, same), "pair_id").first().bleu == pytest.approx(1.0)
    assert ev.corpus_bleu(frame(spark, [("abcd", "wxyz")]), "pair_id").first().bleu == 0.0
    assert ev.corpus_bleu(frame(spark, [("abc", "abc")]), "pair_id").first().bleu == 0.0
    assert ev.corpus_bleu(frame(spark, [("abcdef", "abcde")]), "pair_id").first().bleu == pytest.approx(math.exp(-0.2))


def test_invalid_side_never_matches(spark):
    df = frame(spark, [("a", "a"), ("#", "#"), ("b", "#")])
    convert = lambda c: F.when(c != "#", c)
    assert ev.exact_match(df, convert).first().n_exact == 1
    assert ev.pair_validity(df, lambda c: c != "#").first().n_valid == 1
    report = {r.pair_id: r for r in ev.pair_report(df, "pair_id", lambda c: c != "#").collect()}
    assert (report[1].exact, report[1].valid, report[1].lev) == (0, 0, 0)


def test_tanimoto(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(40)] + [("", ""), ("ab", "ab"), ("abcabc", "abcabc")]
    df = frame(spark, pairs)
    sets = {r.pair_id: r.tanimoto for r in ev.tanimoto_set(df, 3, 2**30).collect()}
    counts = {r.pair_id: r.tanimoto for r in ev.tanimoto_count(df, "pair_id", 3).collect()}
    assert len(counts) == len(pairs)
    for i, (t, p) in enumerate(pairs):
        a = Counter(t[k : k + 3] for k in range(len(t) - 2))
        b = Counter(p[k : k + 3] for k in range(len(p) - 2))
        union = len(set(a) | set(b))
        assert sets[i] == pytest.approx(len(set(a) & set(b)) / union if union else 0.0)
        low, high = sum((a & b).values()), sum((a | b).values())
        assert counts[i] == pytest.approx(low / high if high else 0.0)


def test_same_answer_on_one_and_many_partitions(spark):
    df = frame(spark, SMOKE * 5)
    one = ev.corpus_bleu(df.coalesce(1), "pair_id").first()
    many = ev.corpus_bleu(df.repartition(8), "pair_id").first()
    assert one == many


def test_partitions_follow_the_letters(spark, monkeypatch):
    """A fixed number of partitions would give each task a share of the grams that grows with the table."""
    df = spark.createDataFrame([(i, f"abc{i} text", f"abd{i} text") for i in range(400)] + [(400, None, "x")], "k long, target string, pred string")
    want = ev.corpus_bleu(df, "k").first()
    monkeypatch.setattr(ev, "LETTERS", 100, raising=False)
    letters = sum(2 * len(f"abc{i} text") for i in range(400)) + 1
    assert ev.gram_counts(df, "k", [1, 2]).rdd.getNumPartitions() == -(-letters // 100)
    assert ev.corpus_bleu(df, "k").first() == want
