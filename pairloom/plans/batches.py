"""Shuffle, shards, batches, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import batching as bat
from pairloom.operators import vectors as vec
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query, table

_U = sql.u(fx.SEED, "doc_id")
WORLD = 8


@query("shuffle_head", f"SELECT doc_id, lang FROM documents ORDER BY {_U}, doc_id LIMIT 100")
def shuffle_head(spark, sf):
    return bat.shuffle_head(table(spark, sf, "documents"), "doc_id", fx.SEED, 100).select("doc_id", "lang")


_N = "(SELECT count(*) FROM events)"
_SIZE = f"ceil({_N} / {WORLD}.0)::BIGINT"
# Epoch 3 shuffles with seed + 3.
_SHARDED = (
    f"ranked AS (SELECT event_id, row_number() OVER (ORDER BY {sql.u(fx.SEED + 3, 'event_id')}, event_id) - 1 AS place "
    "FROM events), "
    f"laps AS (SELECT unnest(range(0, {_SIZE} * {WORLD})) AS pos), "
    f"sharded AS (SELECT event_id, pos, pos % {WORLD} AS shard, pos // {WORLD} AS slot "
    f"FROM laps JOIN ranked ON ranked.place = laps.pos % {_N})"
)


@query("shard_rows", f"WITH {_SHARDED} SELECT event_id, pos, shard, slot FROM sharded")
def shard_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return bat.assign_shards(events, ["event_id"], WORLD, fx.SEED, epoch=3).drop("shard_size")


@query(
    "batch_rows",
    f"WITH {_SHARDED}, b AS (SELECT *, slot // 64 AS batch_no FROM sharded) "
    f"SELECT event_id, shard, batch_no, (batch_no + 1) * 64 <= {_SIZE} AS kept_by_drop_last FROM b",
)
def batch_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    rows = bat.assign_batches(
        bat.assign_shards(events, ["event_id"], WORLD, fx.SEED, epoch=3), 64, drop_last=False
    )
    full = (F.col("batch_no") + 1) * 64 <= F.col("shard_size")
    return rows.select("event_id", "shard", "batch_no", full.alias("kept_by_drop_last"))


@query(
    "batch_rows_full",
    f"WITH {_SHARDED}, b AS (SELECT *, slot // 64 AS batch_no FROM sharded) "
    f"SELECT shard, batch_no, count(*) AS n_rows FROM b WHERE (batch_no + 1) * 64 <= {_SIZE} GROUP BY ALL",
)
def batch_rows_full(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    sharded = bat.assign_shards(events, ["event_id"], WORLD, fx.SEED, epoch=3)
    full = bat.assign_batches(sharded, 64, drop_last=True)
    return full.groupBy("shard", "batch_no").agg(F.count("*").alias("n_rows"))


@query(
    "pad_tail",
    "WITH ranked AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) "
    "SELECT doc_id, lang, 0 AS copy FROM ranked UNION ALL SELECT doc_id, lang, 1 FROM ranked "
    "WHERE rn <= 64 - (SELECT count(*) FROM ranked) % 64",
)
def pad_tail(spark, sf):
    return bat.pad_tail(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 64)


@query(
    "pad_tail_exact",
    "WITH ranked AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS rn FROM documents) "
    "SELECT doc_id, source, 0 AS copy FROM ranked UNION ALL SELECT doc_id, source, 1 FROM ranked "
    "WHERE rn <= (40 - (SELECT count(*) FROM ranked) % 40) % 40",
)
def pad_tail_exact(spark, sf):
    """No extra batch where the size fits; rows of one source are told apart by their number."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return bat.pad_tail(docs, "source", 40, exact=True, ties=["doc_id"])


@query(
    "union_sources",
    "SELECT doc_id AS id, text, 0 AS source_no FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark",
)
def union_sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id"))
    return bat.union_sources(docs, items)


@query(
    "zip_pairs",
    "SELECT p_partkey AS pos, p_name AS target, p_type || ' ' || p_brand AS pred FROM part",
)
def zip_pairs(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "pos")
    targets = part.select("pos", F.col("p_name").alias("target"))
    preds = part.select("pos", F.concat_ws(" ", "p_type", "p_brand").alias("pred"))
    return bat.zip_pairs(targets, preds, "pos")


@query(
    "keep_first",
    "SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def keep_first(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return bat.keep_first(docs, ["text"], "doc_id")


@query(
    "memory_bank_size",
    f"WITH {fx.BATCHED_CTE}, sizes AS (SELECT batch_no, count(*) AS rows, count(*) FILTER (member < 32) AS entered "
    "FROM batched GROUP BY batch_no) "
    "SELECT a.batch_no, a.rows, coalesce(sum(b.entered), 0)::BIGINT AS bank_rows, min(b.batch_no) AS bank_from, "
    "(a.rows + coalesce(sum(b.entered), 0))::BIGINT AS candidates FROM sizes a LEFT JOIN sizes b "
    "ON b.batch_no BETWEEN a.batch_no - 4 AND a.batch_no - 1 GROUP BY a.batch_no, a.rows",
)
def memory_bank_size(spark, sf):
    rows = fx.batched_vectors(spark, sf).select("batch_no", (F.col("pos") % fx.BATCH).alias("member"))
    return vec.memory_bank(rows, "batch_no", "member", q=128, per_step=32)
