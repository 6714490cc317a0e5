"""The queries of this subpackage, each a thin call of its operator, and the SQL that states results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import (
    centroids,
    chat,
    decontaminate,
    jaccard,
    line_index,
    lm,
    mixing,
    negatives,
    neighbours,
    quality,
    repeats,
    toxicity,
    warc,
)
from pairloom.plans.sql import u

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op3_repeated_strings",
    """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {L2})) AS string FROM (SELECT doc_id, h, unnest(range(0, n - {L1})) AS i FROM d WHERE n >= {L})),
twice AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY string) > 1),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + {L} AS e FROM (
    SELECT doc_id, i, sum(CASE WHEN i <= before + {L} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice))
  GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM runs
  UNION ALL SELECT doc_id, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
cuts AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)
""".format(L=repeats.LENGTH, L1=repeats.LENGTH - 1, L2=2 * repeats.LENGTH),
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)
    return found.withColumnRenamed("id", "doc_id").drop("spans", "kept")


@query(
    "op4_jaccard_join",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
    ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i : i + 4], ' '))) END)) AS s FROM d),
classes AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.id, a.n, b.id, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT id, id FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT b AS id, min(a) AS component FROM reach GROUP BY b)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON least.id = classes.id
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("id AS doc_id", "n AS n_shingles", "component AS component_id")


SPLIT_WORDS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op2_decontaminate",
    f"""
WITH d AS (SELECT doc_id, coalesce({SPLIT_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {SPLIT_WORDS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM spans)),
runs AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, k, item_id FROM runs JOIN windows USING (k, phrase)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.decontaminate(docs, items))


MIX = f"""
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size,
    {u(mixing.SEED, "doc_id", "source")} AS u
  FROM documents),
sources AS (
  SELECT source, source_size, rank, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM sized GROUP BY source)),
levels AS (
  SELECT *, most / weight AS ratio,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) /
      (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT ratio AS cut_ratio, rank AS cut_rank, level AS chosen FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
plan AS (
  SELECT source, source_size, rank,
    CASE WHEN (ratio, rank) >= (cut_ratio, cut_rank) THEN least(most, chosen * weight) ELSE most END AS target
  FROM levels LEFT JOIN cut ON true),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (
      PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
  FROM sized),
laps AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS whole
  FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source),
mixed AS (
  SELECT doc_id, size, source_size, target,
    (whole * size + greatest(0, least(size, floor(target) - whole * source_size - start_at)))::BIGINT AS taken,
    start_at / target AS share, [1.5, 1.0, 0.5][rank % 3 + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][rank % 3 + 1]::DOUBLE AS b
  FROM laps)"""


@query(
    "op6_curriculum_mix",
    f"""WITH {MIX}
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN 2.0::DOUBLE * share / (a + sqrt(a * a + 2.0::DOUBLE * (b - a) * share)) END AS first_position
FROM mixed""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ordered = mixing.first_positions(mixing.curriculum(docs).drop("text"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "first_position")


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, rules).withColumnRenamed("id", "doc_id")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).withColumnRenamed("id", "doc_id").drop("spans")


@query("op5_hilbert_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query(
    "op7_warc_bundles",
    """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM r""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("record_id")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op9_tool_calls")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = chat.as_tool_calls(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.SCHEMAS, others)


@query("op8_attention_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


FINITE = "embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))"


@query(
    "op11_hard_negatives",
    f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {negatives.MOVED} = 0 THEN (label + 1) % {negatives.LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % {negatives.EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER best <= {negatives.NEGATIVES}""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def _rounds() -> str:
    """Assignment (a) and new centroids (c) of every round."""
    steps = []
    for n in range(centroids.ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT i, c, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c{n}.x) + list_inner_product(c{n}.x, c{n}.x) AS d
    FROM v, c{n}) GROUP BY i)""")
        steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.x, c{n}.x) AS x FROM c{n} LEFT JOIN (
    SELECT c, list(s ORDER BY pos) AS x FROM (
      SELECT c, pos, floor(sum(e)::BIGINT / count(*)) AS s
      FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{n} JOIN v USING (i)) GROUP BY c, pos)
    GROUP BY c) m USING (c))""")
    return ",".join(steps[:-1])


@query(
    "op12_bisector_clusters",
    f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE len(embedding) = {centroids.DIMS} AND {FINITE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (
    SELECT sha256('{centroids.SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {centroids.CENTROIDS})),
{_rounds()}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c{centroids.ROUNDS}.x, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN v USING (i) JOIN c{centroids.ROUNDS} USING (c)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query(
    "op13_line_dedup",
    f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut)),
held AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= {line_index.MIN_POINTS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT lines.*, keeper IS NOT NULL AND keeper <> doc_id AS drop FROM lines LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_index.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
