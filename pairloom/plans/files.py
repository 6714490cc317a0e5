"""Line files: the queries write the given tables as lines into the shared folder and scan them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.text import one_line
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query, table
from pairloom.session import scratch_dir
from pairloom.sources import lines as src

_LINE = f"{sql.strip(sql.one_line('text'))} AS line"
_DOC_LINES = f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {_LINE} FROM documents"


def _write_documents(spark, sf, label: str) -> str:
    path = scratch_dir(spark, label)
    src.write_lines(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], one_line("text"), path)
    return path


@query(
    "scan_lines",
    f"SELECT 0 AS file_no, line_no, line FROM ({_DOC_LINES}) UNION ALL "
    f"SELECT 1, row_number() OVER (ORDER BY item_id) - 1, {_LINE} FROM benchmark",
)
def scan_lines(spark, sf):
    docs = _write_documents(spark, sf, "scan")
    bench = scratch_dir(spark, "scan")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    src.write_lines(items, ["item_id"], one_line("text"), bench)
    return src.read_lines(spark, [docs, bench]).select("file_no", "line_no", "line")


@query("scan_line_range", f"SELECT * FROM ({_DOC_LINES}) WHERE line_no >= 100 AND line_no < 10000000")
def scan_line_range(spark, sf):
    path, index = _write_documents(spark, sf, "range"), scratch_dir(spark, "index")
    src.index_lines(spark, path, index)
    return src.read_line_range(spark, path, 100, 10_000_000, index).select("line_no", "line")


@query("head_copy", f"SELECT * FROM ({_DOC_LINES}) WHERE line_no < 150")
def head_copy(spark, sf):
    source, copy = _write_documents(spark, sf, "head"), scratch_dir(spark, "head")
    src.head_copy(spark, source, copy, 150)
    return src.read_lines(spark, [copy]).select("line_no", "line")


@query(
    "read_vocab",
    "WITH w AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN '##' ELSE '' END || p_name AS word FROM part), "
    "n AS (SELECT row_number() OVER (ORDER BY word) - 1 AS id, replace(word, '##', '') AS token FROM w), "
    "v AS (SELECT token, max(id) AS id FROM n GROUP BY token) "
    "SELECT p_partkey, id FROM part JOIN v ON token = p_name",
)
def read_vocab(spark, sf):
    """A vocabulary file of part names, read back; each part looks its name up."""
    part = table(spark, sf, "part")
    word = F.concat(F.when(F.col("p_partkey") % 2 == 0, "##").otherwise(""), "p_name").alias("word")
    path = scratch_dir(spark, "vocab")
    src.write_lines(part.select(word).distinct(), ["word"], "word", path)
    tokens = src.read_vocab(spark, path).tokens
    known = spark.createDataFrame(list(enumerate(tokens)), "id bigint, token string")
    ids = known.groupBy("token").agg(F.max("id").alias("id"))
    return part.join(ids, F.col("token") == F.col("p_name")).select("p_partkey", "id")


_FIELDS = f"string_split({sql.strip('line')}, chr(9))"
_REPAIRED = (
    f"SELECT line_id, {_FIELDS}[1] AS target, CASE WHEN len({_FIELDS}) = 2 THEN {_FIELDS}[2] ELSE 'Q' END AS pred "
    "FROM pair_lines"
)


@query(
    "roundtrip_pairs",
    f"WITH {fx.PAIR_LINES_CTE}, fixed AS ({_REPAIRED}) "
    "SELECT row_number() OVER (ORDER BY line_id) - 1 AS line_no, target, pred FROM fixed",
)
def roundtrip_pairs(spark, sf):
    path = scratch_dir(spark, "pairs")
    pairs = src.parse_pairs(fx.pair_lines(spark, sf))
    src.write_pairs(pairs, path, ["line_id"])
    return src.read_pairs(spark, path)


@query("repair_pairs", f"WITH {fx.PAIR_LINES_CTE} {_REPAIRED}")
def repair_pairs(spark, sf):
    return src.parse_pairs(fx.pair_lines(spark, sf)).select("line_id", "target", "pred")
