"""Records, sentences and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as tx
from pairloom.functions import tokens as tk
from pairloom.operators import records as rec
from pairloom.operators import tokenize as enc
from pairloom.operators.rows import unnest
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query, table
from pairloom.session import spread

NULL = sql.quote(rec.NULL_TEXT)
_SPLIT = "string_split(line, chr(9))"
_PARSED = (
    f"{fx.RECORDS_CTE}, fields AS (SELECT *, {_SPLIT} AS f, len({_SPLIT}) AS n FROM records), "
    "parsed AS (SELECT doc_id, n > 3 AS bad, CASE WHEN n = 3 THEN f[1] END AS cid, "
    "CASE WHEN n = 3 THEN f[2] WHEN n < 3 THEN f[1] END AS item, "
    f"CASE WHEN n = 1 THEN {NULL} WHEN n <= 3 THEN f[n] END AS description FROM fields)"
)
VOCAB = fx.VOCAB


def _good(spark, sf):
    """Well-formed records with a description column."""
    parsed = rec.parse_records(fx.records(spark, sf), mode="quarantine")
    return parsed.filter("NOT bad").select("doc_id", "cid", "item", "description")


# Records of all documents, each with its whole text.
_ALL_PARSED = _PARSED.replace(fx.RECORDS_CTE, fx.WHOLE_RECORDS_CTE)


def _all(spark, sf):
    parsed = rec.parse_records(fx.whole_records(spark, sf), mode="quarantine")
    return parsed.filter("NOT bad").select("doc_id", "cid", "item", "description")


@query(
    "parse_records",
    f"WITH {_PARSED} SELECT doc_id, cid, item, description FROM parsed WHERE NOT bad",
)
def parse_records(spark, sf):
    return _good(spark, sf)


@query(
    "quarantine_records",
    f"WITH {_PARSED} SELECT doc_id, bad, item IS NULL AS dropped, description FROM parsed",
)
def quarantine_records(spark, sf):
    parsed = rec.parse_records(fx.records(spark, sf), mode="quarantine")
    return parsed.select("doc_id", "bad", F.col("item").isNull().alias("dropped"), "description")


@query(
    "parse_unconditional",
    f"WITH {_PARSED} SELECT doc_id, item, CASE WHEN NOT bad THEN {NULL} END AS description FROM parsed",
)
def parse_unconditional(spark, sf):
    parsed = rec.parse_records(fx.records(spark, sf), unconditional=True, mode="quarantine")
    return parsed.select("doc_id", "item", "description")


@query("first_field", f"WITH {fx.RECORDS_CTE} SELECT doc_id, {_SPLIT}[1] AS item FROM records")
def first_field(spark, sf):
    return rec.parse_records(fx.records(spark, sf), first_only=True).select("doc_id", "item")


@query(
    "label_dropout",
    f"WITH {_ALL_PARSED} SELECT doc_id, CASE WHEN {sql.u(fx.SEED, 'doc_id')} < 0.95 AND NOT item LIKE '%.fr' "
    f"THEN description ELSE {NULL} END AS description FROM parsed WHERE NOT bad",
)
def label_dropout(spark, sf):
    kept = rec.drop_labels(_all(spark, sf), "doc_id", 0.95, fx.SEED, force=F.col("item").endswith(".fr"))
    return kept.select("doc_id", "description")


_HOST = "split_part(split_part(url, '//', 2), '/', 1)"


@query(
    "longest_host_part",
    f"WITH parts AS (SELECT page_id, unnest(string_split({_HOST}, '.')) AS piece, "
    f"unnest(range(0, len(string_split({_HOST}, '.')))) AS place FROM pages) "
    "SELECT page_id, arg_min(piece, -length(piece) * 1000 + place) AS piece FROM parts GROUP BY page_id",
)
def longest_host_part(spark, sf):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", tx.longest_piece(host, ".").alias("piece"))


@query(
    "tag_roundtrip",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '[CLS]' || text END AS tagged, text AS plain "
    "FROM documents",
)
def tag_roundtrip(spark, sf):
    text = F.col("text")
    tagged = F.when(F.col("doc_id") % 3 == 0, text).otherwise(tx.add_tag(text, tk.CLS))
    rows = table(spark, sf, "documents").select("doc_id", tagged.alias("tagged"))
    return rows.withColumn("plain", tx.strip_tag("tagged", tk.CLS))


_SEP = "Q[CLS]"


@query(
    "explode_views",
    "WITH v AS (SELECT p_partkey, unnest([CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END, p_type || ' ' || p_brand]) "
    "AS view, unnest([0::BIGINT, 1]) AS view_no FROM part) "
    "SELECT p_partkey, view_no, upper(view) AS view FROM v WHERE view <> ''",
)
def explode_views(spark, sf):
    first = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.col("p_name"))
    joined = F.concat(first, F.lit(_SEP), F.concat_ws(" ", "p_type", "p_brand"))
    views = table(spark, sf, "part").select("p_partkey", joined.alias("both"))
    return rec.explode_views(views, "both", _SEP, lambda v: F.when(v != "", F.upper(v)))


def _depth_cte(name: str, opening: str, closing: str) -> str:
    marks = f"regexp_replace(text, '[^\\{opening}\\{closing}]', '', 'g')"
    return (
        f"{name}_c AS (SELECT doc_id, unnest(string_split(m, '')) AS ch, unnest(range(0, length(m))) AS place "
        f"FROM (SELECT doc_id, {marks} AS m FROM documents) WHERE m <> ''), "
        f"{name}_d AS (SELECT doc_id, place, sum(CASE WHEN ch = '{opening}' THEN 1 ELSE -1 END) "
        f"OVER (PARTITION BY doc_id ORDER BY place) AS depth FROM {name}_c), "
        f"{name} AS (SELECT doc_id, min(depth) >= 0 AND arg_max(depth, place) = 0 AS ok FROM {name}_d GROUP BY doc_id)"
    )


@query(
    "validity_rate",
    f"WITH {_depth_cte('round', '(', ')')}, {_depth_cte('square', '[', ']')}, "
    f"checked AS (SELECT text, text <> '' AND {sql.covers('text', VOCAB)} AND coalesce(round.ok, TRUE) "
    "AND coalesce(square.ok, TRUE) AS ok FROM documents LEFT JOIN round USING (doc_id) LEFT JOIN square USING (doc_id)) "
    "SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_valid, "
    f"{sql.r6('avg(ok::INT)')} AS validity, count(DISTINCT text) FILTER (ok) AS n_distinct FROM checked",
)
def validity_rate(spark, sf):
    docs = _documents(spark, sf).select("text")
    out = rec.validity(docs, "text", rec.default_validity("text", VOCAB))
    return out.withColumn("validity", F.round("validity", 6))


_DOC_SPLIT = sql.sentences_cte("documents", "doc_id", "text")
_DOC_GROUPS = f"{_DOC_SPLIT}, {sql.groups_cte('doc_id')}"


def _documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _sentences(spark, sf):
    return _documents(spark, sf).select("doc_id", "text", tx.split_sentences("text").alias("s"))


def _groups(spark, sf):
    return _sentences(spark, sf).select("doc_id", "text", tx.regroup_sentences("s").alias("g"))


@query(
    "sentence_split",
    f"WITH {_DOC_SPLIT} SELECT doc_id, unnest(range(0, len(arr))) AS pos, unnest(arr) AS sentence FROM split",
)
def sentence_split(spark, sf):
    return unnest(_sentences(spark, sf), ["doc_id"], "s", "sentence", "pos")


@query("sentence_regroup", f"WITH {_DOC_GROUPS} SELECT doc_id, g::BIGINT AS pos, grp AS sentences FROM groups")
def sentence_regroup(spark, sf):
    return unnest(_groups(spark, sf), ["doc_id"], "g", "sentences", "pos")


_PICK = (
    f"picked AS (SELECT g.doc_id, grp FROM groups g JOIN (SELECT doc_id, count(*) AS n FROM groups GROUP BY doc_id) "
    f"USING (doc_id) WHERE g.g = floor({sql.u(fx.SEED, 'g.doc_id')} * n))"
)


@query(
    "sentence_pick",
    f"WITH {_DOC_GROUPS}, {_PICK} SELECT doc_id, grp AS picked FROM documents LEFT JOIN picked USING (doc_id)",
)
def sentence_pick(spark, sf):
    return _groups(spark, sf).select("doc_id", tx.pick_sentence("g", fx.SEED, "doc_id").alias("picked"))


@query(
    "sentence_subset",
    f"WITH {_DOC_GROUPS}, kept AS (SELECT doc_id, string_agg(grp, ' ' ORDER BY g) AS kept FROM groups "
    f"WHERE g = 0 OR {sql.u(fx.SEED, 'doc_id', 'g::BIGINT')} < 0.5 GROUP BY doc_id) "
    "SELECT doc_id, coalesce(kept, '') AS kept FROM documents LEFT JOIN kept USING (doc_id)",
)
def sentence_subset(spark, sf):
    return _groups(spark, sf).select("doc_id", tx.sample_sentences("g", 0.5, fx.SEED, "doc_id").alias("kept"))


@query(
    "describe_level",
    f"WITH {_ALL_PARSED}, good AS (SELECT doc_id, description FROM parsed WHERE NOT bad), "
    f"{sql.sentences_cte('good', 'doc_id', 'description')}, {sql.groups_cte('doc_id')}, {_PICK} "
    f"SELECT doc_id, CASE WHEN description = {NULL} THEN description ELSE grp END AS sentence, "
    "description AS paragraph FROM good LEFT JOIN picked USING (doc_id)",
)
def describe_level(spark, sf):
    good = _all(spark, sf).select("doc_id", "description", F.col("description").alias("paragraph"))
    return rec.describe(good, "sentence", fx.SEED, "doc_id").select(
        "doc_id", F.col("description").alias("sentence"), "paragraph"
    )


@query(
    "tokenize",
    f"WITH t AS (SELECT doc_id, {sql.tokens('text', VOCAB)} AS toks FROM documents) "
    "SELECT doc_id, len(toks)::INT AS n_tokens, array_to_string(toks, '|') AS toks FROM t",
)
def tokenize(spark, sf):
    toks = _documents(spark, sf).select("doc_id", tk.tokenize("text", VOCAB).alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", "|").alias("toks"))


_LEN = enc.MAX_LEN
_ENCODED = (
    f"enc_t AS (SELECT doc_id, {sql.tokens('text', VOCAB)} AS toks FROM documents), "
    f"enc_v AS (SELECT {sql.vocab_map(VOCAB)} AS m), "
    "enc AS (SELECT doc_id, len(toks)::INT AS n_tokens, "
    f"list_concat(list_transform(toks[1:{_LEN}], lambda t: m[t]::INT), "
    f"list_transform(range(0, greatest({_LEN} - len(toks), 0)), lambda i: 0)) AS ids FROM enc_t, enc_v)"
)


_WHOLE = (
    f"enc_t AS (SELECT doc_id, {sql.tokens('text', VOCAB)} AS toks FROM documents), "
    f"enc_v AS (SELECT {sql.vocab_map(VOCAB)} AS m), "
    "enc AS (SELECT doc_id, len(toks)::INT AS n_tokens, list_transform(toks, lambda t: m[t]::INT) AS ids FROM enc_t, enc_v)"
)


def _encoded(spark, sf):
    return enc.encode(_documents(spark, sf), "text", VOCAB)


@query("encode_ids", f"WITH {_ENCODED} SELECT doc_id, n_tokens, array_to_string(ids, ',') AS ids FROM enc")
def encode_ids(spark, sf):
    return _encoded(spark, sf).select("doc_id", "n_tokens", F.array_join("ids", ",").alias("ids"))


@query(
    "encode_longest",
    f"WITH enc_t AS (SELECT p_partkey, {sql.tokens('p_name', VOCAB)} AS toks FROM part), "
    f"enc_v AS (SELECT {sql.vocab_map(VOCAB)} AS m), "
    "w AS (SELECT p_partkey, toks, p_partkey // 16 AS batch_no, "
    f"least(max(len(toks)) OVER (PARTITION BY p_partkey // 16), {_LEN})::INT AS width FROM enc_t) "
    "SELECT p_partkey, batch_no, width, array_to_string(list_concat(list_transform(toks[1:width], lambda t: m[t]::INT), "
    "list_transform(range(0, greatest(width - len(toks), 0)), lambda i: 0)), ',') AS ids FROM w, enc_v",
)
def encode_longest(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / 16).alias("batch_no"))
    trimmed = enc.trim_batch(enc.encode(rows, "p_name", VOCAB), ["batch_no"], "longest")
    return trimmed.select(
        "p_partkey", "batch_no", F.size("ids").alias("width"), F.array_join("ids", ",").alias("ids")
    )


@query(
    "decode_roundtrip",
    f"WITH {_WHOLE}, cut AS (SELECT doc_id, n_tokens, ids, list_position(ids, 3) AS stop FROM enc), "
    "body AS (SELECT doc_id, CASE WHEN stop > 0 THEN ids[2:stop - 1] ELSE ids[2:] END AS ids FROM cut), "
    f"names AS (SELECT {sql.vocab_list(VOCAB)} AS v) "
    "SELECT doc_id, array_to_string(list_transform(ids, lambda i: v[i + 1]), '') AS decoded FROM body, names",
)
def decode_roundtrip(spark, sf):
    whole = enc.encode(_documents(spark, sf), "text", VOCAB, None)
    return whole.select("doc_id", tk.decode("ids", VOCAB).alias("decoded"))


@query(
    "token_mask",
    "WITH t AS (SELECT item_id, "
    f"len({sql.tokens('text', VOCAB)}) AS n FROM benchmark), "
    "w AS (SELECT item_id, n, max(n) OVER (PARTITION BY item_id // 16) AS width FROM t) "
    "SELECT item_id, repeat('1', n) || repeat('0', width - n) AS mask FROM w",
)
def token_mask(spark, sf):
    """Whole texts, padded to the longest of their batch."""
    items = table(spark, sf, "benchmark").withColumn("batch_no", F.floor(F.col("item_id") / 16))
    padded = enc.pad_batch(enc.encode(items, "text", VOCAB, None), ["batch_no"])
    return padded.select("item_id", F.array_join(tk.attention_mask("ids"), "").alias("mask"))
