"""The queries with SQL against it, and the pipeline stage by stage."""

import hashlib
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from pairloom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    _, rows, verdict = check.compare(spark, check.connect(SF), name, SF)
    assert verdict.startswith("ok") and rows > 0, verdict


def documents(spark):
    long = " ".join(f"word{i} in a sentence of its own" for i in range(60))
    passage = " ".join(f"shared{i} passage" for i in range(40))
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [
        (1, long, "en", "a", 1), (2, long, "en", "b", 1), (3, long.replace("word7 ", "other "), "en", "b", 1),
        (4, "before it " + passage + " " + one, "de", "b", 1), (5, "Before! " + passage + " " + two, "de", None, 1),
        (None, "nothing to see here at all", "fr", "a", 1), (None, "nothing to see here at all", "fr", "a", 1),
        (7, None, None, None, None), (8, "", "en", "a", 0), (8, "", "en", "a", 0),
        (9, "it says: one two three four five six seven eight nine ten eleven", "en", "c", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda df: sorted((r.doc_id or 0 for r in df.collect()))
    kept = pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == pipeline.COLUMNS and ids(kept) == [0, 1, 4, 5, 7, 8, 8, 9]
    cut = pipeline.cut_repeats(spark, kept, str(tmp_path))
    texts = {r.doc_id: r.text for r in cut.collect()}
    # The spaces around the passage repeat too.
    assert cut.columns == pipeline.COLUMNS and texts[4].startswith("before itx0 x1 ") and texts[5].startswith("Before!y0 y1 ")
    assert texts[7] is None and texts[8] == ""
    clean = pipeline.drop_contaminated(spark, cut, str(tmp_path))
    assert ids(clean) == [0, 1, 4, 5, 7, 8, 8]
    mixed = pipeline.mix_sources(spark, clean, str(tmp_path)).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed) and all(r.words <= r.size for r in mixed)
    empty = docs.limit(0)
    for stage in (pipeline.drop_near_copies, pipeline.cut_repeats, pipeline.drop_contaminated, pipeline.mix_sources):
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_keep_quality_on_odd_rows(spark, tmp_path):
    """The classifier's decisions, row by row; null and empty texts, repeated and null ids, an empty table."""
    from pairloom.llm import quality

    good = [(i, f"A calm river ran over stone number {i}, and the light was low. It was green.", "en", "a", 1) for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}### $$@" for _ in range(20)), "en", "b", 1) for i in range(60)]
    odd = [(None, None, None, None, None), (300, "", "en", "a", 0), (300, "", "en", "a", 0), (None, good[0][1], "en", "a", 1), bad[3]]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in good + bad], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = pipeline.keep_quality(spark, docs.withColumn("chars", F.lit("clash")), str(tmp_path))
    rules = quality.fit(docs, labels)
    decided = {(r.id, r.text or ""): r.predicted for r in quality.score(docs, rules).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()}
    assert kept.columns == pipeline.COLUMNS
    got = sorted(map(tuple, kept.collect()), key=repr)
    empty = quality.score(spark.createDataFrame([(1, "")], "doc_id long, text string"), rules).first().predicted
    none = quality.score(spark.createDataFrame([(1, good[0][1])], "doc_id long, text string"), rules).first().predicted
    keeps = lambda r: decided[r[0], r[1] or ""] if r[0] is not None and r[1] else (empty if not r[1] else none)
    assert got == sorted((r for r in good + bad + odd if keeps(r)), key=repr)
    assert len(got) < len(good + bad + odd) and sum(r[0] is not None and r[0] < 100 for r in got) == 60
    assert pipeline.keep_quality(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_keep_quality_computes_each_statistic_once(spark, tmp_path):
    """The rules name a statistic many times; the plan must not hold a copy of its expression for each."""
    from pairloom.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plans = [plan(df).count("regexp_extract_all") for df in (pipeline.keep_quality(spark, docs, SF), quality.with_statistics(docs))]
    assert 0 < plans[0] <= plans[1]


def test_cut_repeats_takes_passages_of_over_50_words(spark, tmp_path):
    """A passage of 51 words has less than 400 bytes here; shorter repeats stay."""
    passage, short = " ".join(f"p{i}th" for i in range(51)), " ".join(f"q{i}th" for i in range(25))
    own = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, f"{own[0]}.{passage}\nA"), (2, f"{own[1]}!{passage} B"), (3, f"{own[2]} {short} C"), (4, f"{own[3]} {short} D")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert 250 < len(passage) < 400 and len(short) < 200
    texts = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    assert texts == {1: own[0] + ".\nA", 2: own[1] + "! B", 3: rows[2][1], 4: rows[3][1]}


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    again = pipeline.run(spark, SF).collect()
    digest = lambda found: hashlib.sha256(repr([tuple(r) for r in found]).encode()).hexdigest()
    assert rows and digest(sorted(rows, key=repr)) == digest(sorted(again, key=repr))
