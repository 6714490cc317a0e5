import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.operators import records as rec


def sentences(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tx.split_sentences("t")).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        (
            "a...b Mr. X went. U.S. The end?! Ph.D. i.e. x 3.14.",
            ["a...", "b Mr. X went.", "U.S. The end?", "!", "Ph.D. i.e. x 3.14."],
        ),
        ("Wait..... ok!", ["Wait.....", "ok!"]),
        ('He said "hi." Then left.', ['He said "hi".', "Then left."]),
        ("no dot", ["no dot"]),
        ("", []),
        ("   ", []),
        ("See www.site.com now. Next.", ["See www.", "site.com now.", "Next."]),
        ("Acme Inc. He left. Foo Ltd. grew.", ["Acme Inc", "He left.", "Foo Ltd. grew."]),
        ("First\nline. Second.", ["First line.", "Second."]),
        ("“Quote.” Next.", ["“Quote”.", "Next."]),
        ("It is v1.2.3 here.", ["It is v1.2.", "3 here."]),
    ],
)
def test_split_sentences(spark, text, expected):
    assert sentences(spark, text) == expected


@pytest.mark.parametrize(
    "arr,expected",
    [
        (["(1) a.", "2 b.", "C.", "3 d."], ["(1) a. 2 b.", "C. 3 d."]),
        (["A.", "B."], ["A.", "B."]),
        (["1", "2", "3"], ["1 2 3"]),
        (["Ä.", "é.", "9."], ["Ä.", "é. 9."]),
        ([], []),
    ],
)
def test_regroup(spark, arr, expected):
    df = spark.createDataFrame([(arr,)], "a array<string>")
    assert df.select(tx.regroup_sentences("a")).first()[0] == expected


def test_pick_is_uniform_and_null_for_nothing(spark):
    df = spark.range(900).select("id", F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("g"))
    counts = dict(df.select(tx.pick_sentence("g", 5, "id").alias("p")).groupBy("p").count().collect())
    assert set(counts) == {"a", "b", "c"} and min(counts.values()) > 240
    empty = spark.createDataFrame([(1, [])], "id int, g array<string>")
    assert empty.select(tx.pick_sentence("g", 5, "id")).first()[0] is None


def test_sample_keeps_the_first(spark):
    df = spark.range(500).select("id", F.array(F.lit("a"), F.lit("b")).alias("g"))
    values = [r[0] for r in df.select(tx.sample_sentences("g", 0.5, 5, "id")).collect()]
    assert set(values) == {"a", "a b"} and 200 < values.count("a") < 300


def test_strip_knows_unicode_space(spark):
    df = spark.createDataFrame([("　\t a b \x1f\xa0",)], "t string")
    assert df.select(tx.strip("t")).first()[0] == "a b"


def test_tags_and_pieces(spark):
    df = spark.createDataFrame([("[CLS]x", "aa.b.cc"), ("x", "abc"), ("", "")], "t string, p string")
    rows = df.select(tx.strip_tag("t", "[CLS]"), tx.add_tag("t", "[CLS]"), tx.longest_piece("p", ".")).collect()
    assert [tuple(r) for r in rows] == [("x", "[CLS][CLS]x", "aa"), ("x", "[CLS]x", "abc"), ("", "[CLS]", "")]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def test_parse_records_by_arity(spark):
    df = rec.parse_records(lines(spark, "7\tC\tdesc", "C\tdesc", "C", "C\t"), null_text="none")
    assert [(r.cid, r.item, r.description) for r in df.collect()] == [
        ("7", "C", "desc"),
        (None, "C", "desc"),
        (None, "C", "none"),
        (None, "C", ""),
    ]
    alone = rec.parse_records(lines(spark, "7\tC\td\te"), first_only=True).first()
    assert alone.item == "7"


def test_malformed_records_fail_or_are_flagged(spark):
    bad = lines(spark, "a\tb\tc\td", "C\tx")
    with pytest.raises(Exception, match="more than three fields"):
        rec.parse_records(bad).collect()
    flagged = rec.parse_records(bad, mode="quarantine").collect()
    assert [(r.bad, r.item) for r in flagged] == [(True, None), (False, "C")]
    with pytest.raises(ValueError):
        rec.parse_records(bad, mode="other")


def test_unconditional(spark):
    df = rec.parse_records(lines(spark, "C\tdesc"), unconditional=True)
    assert df.first().description == rec.NULL_TEXT


def test_label_dropout(spark):
    df = spark.range(2000).select("id", F.lit("d").alias("description"))
    kept = rec.drop_labels(df, "id", 0.95, 1).filter("description = 'd'").count()
    assert 1850 < kept < 1950
    forced = rec.drop_labels(df, "id", 1.0, 1, force=F.col("id") < 10)
    assert forced.filter("description = 'd'").count() == 1990


def test_describe(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, rec.NULL_TEXT), (3, "")], "id int, description string")
    assert rec.describe(df, "paragraph", 1, "id") is df
    rows = {r.id: r.description for r in rec.describe(df, "sentence", 1, "id").collect()}
    assert rows[1] in ("One.", "Two.") and rows[2] == rec.NULL_TEXT and rows[3] is None
    with pytest.raises(ValueError):
        rec.describe(df, "word", 1, "id")


def test_explode_views_drops_what_does_not_convert(spark):
    df = spark.createDataFrame([(1, "[CLS]aQ[CLS]b"), (2, "[CLS]c"), (3, "xQ[CLS]d")], "id int, v string")
    out = rec.explode_views(df, "v", "Q", lambda v: F.when(v.startswith("[CLS]"), v))
    assert sorted((r.id, r.view_no, r.view) for r in out.collect()) == [
        (1, 0, "[CLS]a"),
        (1, 1, "[CLS]b"),
        (2, 0, "[CLS]c"),
        (3, 1, "[CLS]d"),
    ]


def test_validity(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",), ("!",)], "t string")
    row = rec.validity(df, "t", F.col("t").rlike("^[a-z]*$")).first()
    assert (row.n_rows, row.n_valid, row.n_distinct) == (6, 3, 2) and row.validity == 0.5
    none = rec.validity(df.filter("t = 'zz'"), "t", F.lit(True)).first()
    assert (none.n_rows, none.validity) == (0, 0.0)
