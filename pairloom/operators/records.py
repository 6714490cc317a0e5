"""Records of one to three tab fields, label dropout, views, validity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.rand import uniform
from pairloom.functions.text import (
    pick_sentence,
    regroup_sentences,
    split_sentences,
)
from pairloom.functions.tokens import Vocabulary, balanced, covers
from pairloom.functions.util import as_col
from pairloom.operators.rows import unnest

# Fixed value: the description of a record that has none.
NULL_TEXT = "no description."


def parse_records(
    df: DataFrame,
    line: str = "line",
    null_text: str = NULL_TEXT,
    first_only: bool = False,
    unconditional: bool = False,
    mode: str = "failfast",
) -> DataFrame:
    """Add ``cid, item, description`` from a line of 1, 2 or 3 tab fields.

    More than three fields: ``failfast`` raises when the row is evaluated, ``quarantine`` sets the
    ``bad`` flag and leaves the three columns null.
    """
    if mode not in ("failfast", "quarantine"):
        raise ValueError(f"unknown mode: {mode}")
    with_fields = df.withColumn("_f", F.split(F.col(line), "\t", -1))
    f, n = F.col("_f"), F.size("_f")
    if first_only:
        return with_fields.withColumn("item", f[0]).drop("_f")
    bad = n > 3
    item = F.when(n == 3, F.get(f, F.lit(1))).when(~bad, f[0])
    found = F.when(n == 1, F.lit(null_text)).when(~bad, F.element_at(f, -1))
    description = F.when(~bad, F.lit(null_text)) if unconditional else found
    if mode == "failfast":
        message = F.concat(F.lit("more than three fields: "), F.col(line))
        item = F.when(bad, F.raise_error(message)).otherwise(item)
    out = with_fields.withColumns(
        {"cid": F.when(n == 3, f[0]), "item": item, "description": description}
    )
    if mode == "quarantine":
        out = out.withColumn("bad", bad)
    return out.drop("_f")


def drop_labels(
    df: DataFrame,
    key: str,
    p_keep: float,
    seed: int,
    column: str = "description",
    null_text: str = NULL_TEXT,
    force: Column | None = None,
) -> DataFrame:
    """Replace the label by the null text with chance ``1 - p_keep``, or where ``force`` holds."""
    keep = uniform(seed, key) < p_keep
    if force is not None:
        keep = keep & ~F.coalesce(force, F.lit(False))
    return df.withColumn(column, F.when(keep, F.col(column)).otherwise(F.lit(null_text)))


def describe(
    df: DataFrame, level: str, seed: int, key: str, column: str = "description", null_text: str = NULL_TEXT
) -> DataFrame:
    """``paragraph``: the raw text. ``sentence``: one group of sentences; the null text stays."""
    if level == "paragraph":
        return df
    if level != "sentence":
        raise ValueError(f"unknown level: {level}")
    return (
        df.withColumn("_s", split_sentences(column))
        .withColumn("_g", regroup_sentences("_s"))
        .withColumn(
            column,
            F.when(F.col(column) == null_text, F.col(column)).otherwise(pick_sentence("_g", seed, key)),
        )
        .drop("_s", "_g")
    )


def explode_views(
    df: DataFrame,
    column: str,
    sep: str,
    convert: Callable[[Column], Column] | None = None,
    out: str = "view",
) -> DataFrame:
    """One row per view, numbered by ``view_no``; a view that converts to null is dropped."""
    pieces = F.split(F.col(column), "\\Q" + sep + "\\E", -1)
    rows = unnest(df, [c for c in df.columns if c != column], pieces, out, "view_no")
    if convert is not None:
        rows = rows.withColumn(out, convert(F.col(out))).filter(F.col(out).isNotNull())
    return rows


def default_validity(text: Column | str, vocab: Vocabulary) -> Column:
    """Non-empty, all characters in tokens, round and square brackets balanced."""
    text = as_col(text)
    return (
        (text != "") & covers(text, vocab) & balanced(text, "(", ")") & balanced(text, "[", "]")
    )


def validity(df: DataFrame, column: str, is_valid: Column) -> DataFrame:
    """One row: rows, valid rows, their share (0.0 for none), distinct valid values.

    The distinct count aggregates by a 256-bit digest of the value before it counts: texts do not cross
    the network, and a value held by many rows is folded on the map side.
    """
    ok = F.coalesce(is_valid, F.lit(False)) & (F.coalesce(F.col(column), F.lit("")) != "")
    per_value = df.select(F.sha2(F.col(column), 256).alias("v"), ok.alias("ok")).groupBy("v", "ok").count()
    return per_value.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("count"))), F.lit(0)).alias("n_valid"),
        F.coalesce(
            F.sum(F.when(F.col("ok"), F.col("count")).otherwise(0)) / F.sum("count"), F.lit(0.0)
        ).alias("validity"),
        F.count_if("ok").alias("n_distinct"),
    )
