"""Encoding of a text column and truncation per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.tokens import PAD, Vocabulary, fit, token_ids, tokenize

MAX_LEN = 127


def encode(df: DataFrame, column: str, vocab: Vocabulary, max_len: int | None = MAX_LEN) -> DataFrame:
    """Add ``ids`` (exactly ``max_len``) and ``n_tokens`` (before padding or cutting).

    With ``max_len`` None the ids of the whole text stay as they are.
    """
    ids = token_ids(df.sparkSession, "_tokens", vocab)
    if max_len is None:
        whole = df.withColumn("_tokens", tokenize(column, vocab))
        return whole.withColumns({"n_tokens": F.size("_tokens"), "ids": ids}).drop("_tokens")
    return (
        df.withColumn("_tokens", tokenize(column, vocab))
        .withColumn("n_tokens", F.size("_tokens"))
        # Only what is kept is looked up.
        .withColumn("_tokens", F.slice("_tokens", 1, max_len))
        .withColumn("ids", fit(ids, max_len, vocab.index(PAD)))
        .drop("_tokens")
    )


def trim_batch(df: DataFrame, batch: list[str], mode: str) -> DataFrame:
    """``max_len`` keeps the full width; ``longest`` cuts to the longest row of the batch.

    The window holds one batch, which is what fits in one tensor.
    """
    if mode == "max_len":
        return df
    if mode != "longest":
        raise ValueError("mode is max_len or longest")
    widest = F.max("n_tokens").over(Window.partitionBy(*batch))
    return df.withColumn("ids", F.slice("ids", F.lit(1), widest))


def pad_batch(df: DataFrame, batch: list[str], pad_id: int = 0) -> DataFrame:
    """Pad whole ``ids`` to the longest row of their batch."""
    widest = F.max("n_tokens").over(Window.partitionBy(*batch))
    padding = F.array_repeat(F.lit(pad_id), (widest - F.col("n_tokens")).cast("int"))
    return df.withColumn("ids", F.concat("ids", padding))
