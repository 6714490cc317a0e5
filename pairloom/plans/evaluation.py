"""String quality of pairs: short labels from ``part``, whole turns from ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import tokens as tk
from pairloom.operators import batching
from pairloom.operators import evaluate as ev
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query
from pairloom.sources import lines as src

_P = fx.PART_PAIRS_CTE
# A label is valid where it is covered and says how large the part is.
_VALID = r"(regexp_matches({0}, '\([0-9]+\)$') AND {0} NOT LIKE '%widget%')"
_SAME = "lower(trim(regexp_replace(target, ' Brand.*', ''))) = lower(trim(regexp_replace(pred, ' Brand.*', '')))"


def _valid(text):
    return text.rlike(r"\([0-9]+\)$") & ~text.contains("widget")


def _normal(text):
    return F.lower(F.trim(F.regexp_replace(text, " Brand.*", "")))


@query(
    "exact_match",
    f"WITH {_P} SELECT count(*) AS n_pairs, sum(({_SAME})::INT)::BIGINT AS n_exact, "
    f"{sql.r6(f'avg(({_SAME})::INT)')} AS exact_match FROM pairs",
)
def exact_match(spark, sf):
    out = ev.exact_match(fx.part_pairs(spark, sf), _normal)
    return out.withColumn("exact_match", F.round("exact_match", 6))


@query("edit_distance", f"WITH {_P} SELECT pair_id, levenshtein(target, pred)::INT AS lev FROM pairs")
def edit_distance(spark, sf):
    return ev.edit_distance(fx.part_pairs(spark, sf)).select("pair_id", "lev")


def _grams_cte(side: str, n: str, source: str = "pairs") -> str:
    return (
        f"{side}_g AS (SELECT pair_id, n, substring({side}, i::BIGINT, n) AS gram, count(*) AS c FROM "
        f"(SELECT pair_id, {side}, n, unnest(range(1, length({side}) - n + 2)) AS i FROM "
        f"(SELECT pair_id, {side}, unnest({n}) AS n FROM {source})) GROUP BY ALL)"
    )


def _bleu(source_cte: str) -> str:
    totals = ", ".join(f"sum(greatest(length(pred) - {n} + 1, 1))::BIGINT AS total_{n}" for n in range(1, 5))
    matches = ", ".join(
        f"coalesce(sum(least(t.c, p.c)) FILTER (n = {n}), 0)::BIGINT AS match_{n}" for n in range(1, 5)
    )
    none = " OR ".join(f"match_{n} = 0" for n in range(1, 5))
    logs = " + ".join(f"ln(match_{n} / total_{n}) / 4" for n in range(1, 5))
    return (
        f"{source_cte}, {_grams_cte('target', '[1, 2, 3, 4]')}, {_grams_cte('pred', '[1, 2, 3, 4]')}, "
        f"matched AS (SELECT {matches} FROM target_g t JOIN pred_g p USING (pair_id, n, gram)), "
        f"lens AS (SELECT sum(length(target))::BIGINT AS target_len, sum(length(pred))::BIGINT AS pred_len, {totals} FROM pairs), "
        f"bleu AS (SELECT *, CASE WHEN {none} THEN 0 ELSE CASE WHEN pred_len > target_len THEN 1 "
        f"ELSE exp(1 - target_len / pred_len) END * exp({logs}) END AS b FROM matched, lens)"
    )


_NAMES = [f"match_{n}" for n in range(1, 5)] + [f"total_{n}" for n in range(1, 5)]


@query(
    "corpus_bleu",
    f"WITH {_bleu(fx.TALK_PAIRS_CTE)} SELECT {', '.join(_NAMES)}, target_len, pred_len, {sql.r6('b')} AS bleu FROM bleu",
)
def corpus_bleu(spark, sf):
    out = ev.corpus_bleu(fx.talk_pairs(spark, sf), "pair_id")
    return out.select(*_NAMES, "target_len", "pred_len", F.round("bleu", 6).alias("bleu"))


_BITS = (
    "{0}_b AS (SELECT DISTINCT pair_id, ('0x' || substr(md5(substring({0}, i::BIGINT, 3)), 1, 8))::BIGINT % 2048 AS bit FROM "
    "(SELECT pair_id, {0}, unnest(range(1, length({0}) - 1)) AS i FROM pairs))"
)


@query(
    "tanimoto_set",
    f"WITH {fx.TALK_PAIRS_CTE}, {_BITS.format('target')}, {_BITS.format('pred')}, "
    "na AS (SELECT pair_id, count(*) AS a FROM target_b GROUP BY 1), nb AS (SELECT pair_id, count(*) AS b FROM pred_b GROUP BY 1), "
    "nc AS (SELECT pair_id, count(*) AS c FROM target_b JOIN pred_b USING (pair_id, bit) GROUP BY 1), "
    "s AS (SELECT pair_id, coalesce(c, 0) / nullif(coalesce(a, 0) + coalesce(b, 0) - coalesce(c, 0), 0) AS tan FROM pairs "
    "LEFT JOIN na USING (pair_id) LEFT JOIN nb USING (pair_id) LEFT JOIN nc USING (pair_id)) "
    f"SELECT pair_id, {sql.r6('coalesce(tan, 0)')} AS tanimoto FROM s",
)
def tanimoto_set(spark, sf):
    out = ev.tanimoto_set(fx.talk_pairs(spark, sf), 3, 2048)
    return out.select("pair_id", F.round("tanimoto", 6).alias("tanimoto"))


@query(
    "tanimoto_count",
    f"WITH {fx.TALK_PAIRS_CTE}, {_grams_cte('target', '[3]')}, {_grams_cte('pred', '[3]')}, "
    "j AS (SELECT pair_id, least(coalesce(t.c, 0), coalesce(p.c, 0)) AS lo, coalesce(t.c, 0) + coalesce(p.c, 0) AS al "
    "FROM target_g t FULL JOIN pred_g p USING (pair_id, n, gram)), "
    "s AS (SELECT pair_id, sum(lo) / (sum(al) - sum(lo)) AS tan FROM j GROUP BY pair_id) "
    f"SELECT pair_id, {sql.r6('coalesce(tan, 0)')} AS tanimoto FROM pairs LEFT JOIN s USING (pair_id)",
)
def tanimoto_count(spark, sf):
    out = ev.tanimoto_count(fx.talk_pairs(spark, sf), "pair_id")
    return out.withColumn("tanimoto", F.round("tanimoto", 6))


_BOTH = f"({_VALID.format('target')} AND {_VALID.format('pred')})"


@query(
    "pair_validity",
    f"WITH {_P} SELECT count(*) AS n_pairs, sum({_BOTH}::INT)::BIGINT AS n_valid, "
    f"{sql.r6(f'avg({_BOTH}::INT)')} AS validity FROM pairs",
)
def pair_validity(spark, sf):
    out = ev.pair_validity(fx.part_pairs(spark, sf), _valid)
    return out.withColumn("validity", F.round("validity", 6))


_REPORT = (
    f"report AS (SELECT pair_id, target AS ground_truth, pred AS prediction, ({_SAME} AND {_BOTH})::INT AS exact, "
    f"{_BOTH}::INT AS valid, levenshtein(target, pred)::INT AS lev FROM pairs)"
)


@query("pair_report", f"WITH {_P}, {_REPORT} SELECT * FROM report")
def pair_report(spark, sf):
    return ev.evaluate_pairs(fx.part_pairs(spark, sf), "pair_id", _valid, _normal)[0]


@query(
    "pair_summary",
    f"WITH {_bleu(_P)}, {_REPORT}, {_BITS.format('target')}, {_BITS.format('pred')}, "
    "na AS (SELECT pair_id, count(*) AS a FROM target_b GROUP BY 1), nb AS (SELECT pair_id, count(*) AS b FROM pred_b GROUP BY 1), "
    "nc AS (SELECT pair_id, count(*) AS c FROM target_b JOIN pred_b USING (pair_id, bit) GROUP BY 1), "
    "by_set AS (SELECT avg(coalesce(coalesce(c, 0) / nullif(coalesce(a, 0) + coalesce(b, 0) - coalesce(c, 0), 0), 0)) AS m FROM report "
    "LEFT JOIN na USING (pair_id) LEFT JOIN nb USING (pair_id) LEFT JOIN nc USING (pair_id) WHERE valid = 1), "
    "j AS (SELECT pair_id, least(coalesce(t.c, 0), coalesce(p.c, 0)) AS lo, coalesce(t.c, 0) + coalesce(p.c, 0) AS al "
    "FROM (FROM target_g WHERE n = 3) t FULL JOIN (FROM pred_g WHERE n = 3) p USING (pair_id, n, gram)), "
    "tans AS (SELECT pair_id, sum(lo) / (sum(al) - sum(lo)) AS tan FROM j GROUP BY pair_id), "
    "by_count AS (SELECT avg(coalesce(tan, 0)) AS m FROM report LEFT JOIN tans USING (pair_id) WHERE valid = 1) "
    f"SELECT count(*) AS n_pairs, {sql.r6('(SELECT m FROM by_set)')} AS mean_tanimoto_set, "
    f"{sql.r6('(SELECT m FROM by_count)')} AS mean_tanimoto_count, {sql.r6('avg(exact)')} AS exact_match, "
    f"{sql.r6('avg(lev)')} AS mean_lev, {sql.r6('avg(valid)')} AS validity, "
    f"{sql.r6('(SELECT b FROM bleu)')} AS bleu FROM report",
)
def pair_summary(spark, sf):
    out = ev.evaluate_pairs(fx.part_pairs(spark, sf), "pair_id", _valid, _normal)[1]
    names = ("exact_match", "mean_lev", "validity", "bleu", "mean_tanimoto_set", "mean_tanimoto_count")
    return out.select("n_pairs", *[F.round(c, 6).alias(c) for c in names])


_COVERED = sql.covers("{0}", fx.VOCAB)


@query(
    "generation_score",
    "WITH "
    + fx.PAIR_LINES_CTE
    + f", cut AS (SELECT line_id, string_split({sql.strip('line')}, chr(9)) AS f FROM pair_lines), "
    + "fixed AS (SELECT line_id, f[1] AS target, CASE WHEN len(f) = 2 THEN f[2] ELSE 'Q' END AS pred FROM cut), "
    + "firsts AS (SELECT * FROM fixed QUALIFY row_number() OVER (PARTITION BY target ORDER BY line_id) = 1), "
    + "report AS (SELECT (lower(trim(target)) = lower(trim(pred)))::INT AS same, "
    + f"({_COVERED.format('target')} AND {_COVERED.format('pred')})::INT AS valid, "
    + "length(target) AS target_len, length(pred) AS pred_len FROM firsts) "
    + f"SELECT count(*) AS n_pairs, {sql.r6('avg(valid)')} AS validity, {sql.r6('avg(same * valid)')} AS exact_match, "
    + "sum(target_len)::BIGINT AS target_len, sum(pred_len)::BIGINT AS pred_len FROM report",
)
def generation_score(spark, sf):
    """Repair pairs, keep the first of each target, score them: the end of a generation run."""
    pairs = src.parse_pairs(fx.pair_lines(spark, sf))
    firsts = batching.keep_first(pairs, ["target"], "line_id")
    report = firsts.select(
        (tk.covers("target", fx.VOCAB) & tk.covers("pred", fx.VOCAB)).cast("int").alias("valid"),
        ev.exact_flag().alias("same"),
        F.length("target").alias("target_len"),
        F.length("pred").alias("pred_len"),
    )
    return report.agg(
        F.count("*").alias("n_pairs"),
        F.round(F.avg("valid"), 6).alias("validity"),
        F.round(F.avg(F.col("same") * F.col("valid")), 6).alias("exact_match"),
        F.sum("target_len").alias("target_len"),
        F.sum("pred_len").alias("pred_len"),
    )
