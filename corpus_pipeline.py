"""A corpus pipeline of five stages over ``documents``: each stage works on all that the one before kept.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> benchmark decontamination -> mixing.
All but the last return the columns of ``documents``. Operators name rows by a hash of the whole row (``row``), so
ids may be null or repeat; rows that agree in all columns share a name and a fate. Each stage writes its decisions
and removes the tables of its operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, jaccard, mixing, quality, repeats
from pairloom.llm.components import decided, written
from pairloom.operators.rows import unnest_structs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = 200  # bytes: 51 words of plain text have 250 to 480


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(docs: DataFrame) -> DataFrame:
    """Rows with the hash of all their columns in ``row``; nulls are hashed too, since the hash alone would skip them."""
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "text")


def _renewed(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it is fitted on the labels of this stage's documents.

    Null and empty texts are scored as empty ones, whatever that gives; ids may be null or repeat; an empty table gives none.
    """
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    base = docs.select(*COLUMNS)
    stats = base.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    counted = stats.select(*COLUMNS, *[c.alias(f"_{n}") for n, c in quality.statistics().items()])
    renamed = quality.Rules(tuple(f"_{n}" for n in rules.features), rules.rules, rules.bias)
    # Behind a generator: a filter moved below the projection would hold a copy of the statistics for each use in the rules.
    scored = unnest_structs(counted, COLUMNS, F.array(F.struct(renamed.column().alias("_score"))), "_score")
    return scored.filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (null ids last, then any).

    Documents without words are linked with nothing and all stay.
    """
    rows = _named(docs)

    def decide() -> DataFrame:
        """The rows that go, and those that stay once of several equal ones."""
        found = jaccard.near_duplicates(_keyed(rows)).filter("n > 0").select(F.col("id").alias("row"), "component")
        groups = found.groupBy("row").agg(F.min("component").alias("component"), F.count("*").alias("copies"))
        ids = rows.select("row", "doc_id").distinct().join(groups, "row")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        first = ids.groupBy("component").agg(F.min(order).alias("first"))
        kept = first.select(F.col("first.row").alias("row"), F.lit(True).alias("keep"))
        marked = groups.join(kept, "row", "left").select("row", F.coalesce("keep", F.lit(False)).alias("keep"), "copies")
        return marked.filter("NOT keep OR copies > 1")

    marked = rows.join(decided(spark, "near_copies", decide), "row", "left")
    single = marked.filter("keep IS NULL").select(*COLUMNS)
    return single.union(marked.filter("keep").select(*COLUMNS).distinct())


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of a string of ``PASSAGE`` bytes that also starts elsewhere; texts that vanish go.

    ``op3`` takes the 400 bytes of its contract; passages of just over 50 words are shorter than that. A cut may fall inside a character; its remaining bytes are replaced by the replacement character.
    Texts that were empty or null before stay as they are.
    """
    rows = _named(docs)

    def decide() -> DataFrame:
        found = repeats.remove_repeats(_keyed(rows), PASSAGE).filter("n_removed > 0")
        # Equal rows lose the same bytes.
        return found.groupBy(F.col("id").alias("row")).agg(*[F.max(c).alias(c) for c in ("kept", "n_bytes", "n_removed")])

    joined = rows.join(decided(spark, "cut", decide), "row", "left").filter("n_removed IS NULL OR n_removed < n_bytes")
    text = F.when(F.col("n_removed").isNull(), F.col("text")).otherwise(_decode(F.col("kept")))
    return _renewed(joined, text)


def _decode(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item. Those without words hold none and stay."""
    rows = _named(docs)
    items = _table(spark, sf_dir, "benchmark")
    find = lambda: decontaminate.decontaminate(_keyed(rows), items).filter("n_hit > 0")
    hit = decided(spark, "contaminated", lambda: find().select(F.col("id").alias("row")).distinct())
    return rows.join(hit, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per lap that takes of a document, range-sorted by its position.

    Documents without words have nothing to take and no row; a null source is a source of its own.
    """
    mixed = mixing.curriculum(docs.select("doc_id", "text", "source"))
    ordered = mixing.training_order(mixed.drop("text"))
    return ordered.select("doc_id", "source", "size", "target", "taken", "lap", "words", "position")


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources),
]

# SQL cannot express the classifier's fit; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
