"""Retrieval inside batches: scores, hits, best candidates, accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.rand import normals_of, row_words, uniform_int
from pairloom.functions.vectors import sum_of_squares, to_double
from pairloom.operators.blocks import batch_best, batch_products, list_column, matrix
from pairloom.operators.noise import held
from pairloom.operators.rows import unnest
from pairloom.operators.vectors import top_k
from pairloom.session import place

# Scores that agree to this many places are ties.
TIE_DIGITS = 9
FOLD_ROWS = 256  # queries whose noise is drawn at a time: 1.3 MB an array for 10 rounds of 64 entries


def _fold_rows(x: np.ndarray, ab: np.ndarray, words: list[np.ndarray], dims: int) -> np.ndarray:
    rows, rounds = ab.shape
    eps = normals_of(*words, dims).reshape(rows, rounds, dims)
    noisy = np.sqrt(ab)[:, :, None] * x[:, None, :] + np.sqrt(1.0 - ab)[:, :, None] * eps
    scale = 1.0 / ((1.0 - ab) * dims)
    left = ((-2.0 * np.sqrt(ab) * scale)[:, :, None] * noisy).sum(axis=1)
    square = (ab * scale).sum(axis=1, keepdims=True)
    constant = ((noisy**2).sum(axis=2) * scale).sum(axis=1, keepdims=True)
    return np.concatenate([left, square, constant], axis=1)


def fold_rows(x: np.ndarray, ab: np.ndarray, words: list[np.ndarray], dims: int) -> np.ndarray:
    """Rounds of each query folded to one row. The noise of FOLD_ROWS queries exists at a time, not that of an Arrow batch."""
    rounds = ab.shape[1]
    out = np.empty((len(x), dims + 2))
    for lo in range(0, len(x), FOLD_ROWS):
        some, theirs = slice(lo, lo + FOLD_ROWS), slice(lo * rounds, (lo + FOLD_ROWS) * rounds)
        out[some] = _fold_rows(x[some], ab[some], [w[theirs] for w in words], dims)
    return out


def _fold_rounds(alpha_bars: np.ndarray, dims: int):
    """Rounds of a query folded to one vector: its weight per entry, for ``|c|^2``, and a constant."""

    @F.arrow_udf("array<double>")
    def fold(query: pa.Array, t: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = len(query)
        ab = alpha_bars[matrix(t, rows).astype(np.int64)]
        words = [w.flatten().to_numpy(zero_copy_only=False) for w in (first, second)]
        return list_column(fold_rows(matrix(query, rows), ab, words, dims))

    return fold


def _folded(
    df: DataFrame, coefs: DataFrame, batch: str, pos: str, query: str, candidate: str, dims: int, n_iter: int, seed: int, lo: int, hi: int
) -> DataFrame:
    """Queries and candidates as vectors whose dot product and ``_const`` are the error: ``_left``, ``_right``."""
    table = held(coefs.select("t", "alpha_bar")).toArrow().sort_by("t")
    fold = _fold_rounds(table["alpha_bar"].to_numpy(), dims)
    rounds = [F.lit(r) for r in range(n_iter)]
    words = [row_words(seed + 1, r, pos) for r in rounds]
    folded = df.withColumn(
        "_f",
        fold(
            to_double(query),
            F.array(*[uniform_int(seed, lo, hi, r, pos) for r in rounds]),
            F.array(*[a for a, _ in words]),
            F.array(*[b for _, b in words]),
        ),
    )
    kept = [c for c in df.columns if c not in (query, candidate)]
    return place(folded.select(*kept, to_double(candidate).alias("_c"), "_f"), batch).select(
        *kept,
        F.element_at("_f", dims + 2).alias("_const"),
        F.slice("_f", 1, dims + 1).alias("_left"),
        F.concat("_c", F.array(sum_of_squares("_c"))).alias("_right"),
    )


def score_candidates(
    df: DataFrame,
    coefs: DataFrame,
    batch: str,
    pos: str,
    query: str,
    candidate: str,
    dims: int,
    n_iter: int,
    seed: int,
    lo: int = 50,
    hi: int = 950,
) -> DataFrame:
    """Per query, the summed error of every candidate of its batch: ``member, scores``.

    Step and noise are drawn once per query and round and shared by all candidates. The error of a
    candidate c in a round is ``mean((x_t - sqrt(ab) c)^2) / (1 - ab)``. That is a constant, a dot
    product with c and a multiple of ``|c|^2``, and all three add up over the rounds. So the rounds
    are folded per query, row by row, and each pair costs one dot product instead of ``n_iter``.
    The only shuffle is the one by batch. The schedule (at most MAX_STEPS numbers) goes with the
    function. All scores of a batch are held; ``best_candidates`` holds the best only.
    """
    both = _folded(df, coefs, batch, pos, query, candidate, dims, n_iter, seed, lo, hi)
    products = batch_products(both, [batch], pos, "_left", "_right")
    return products.withColumn(
        "scores", F.transform("products", lambda p: p + F.col("_const"))
    ).drop("products", "_const")


def best_candidates(
    df: DataFrame,
    coefs: DataFrame,
    batch: str,
    pos: str,
    query: str,
    candidate: str,
    dims: int,
    n_iter: int,
    seed: int,
    lo: int = 50,
    hi: int = 950,
    k: int = 1,
) -> DataFrame:
    """Per query, the ``k`` candidates of its batch with the lowest summed error of ``score_candidates``.

    Adds ``member``, ``found`` (structs of ``place`` and ``score``), ``best`` (the first place) and ``hit``. Scores that agree to
    TIE_DIGITS places are ties, and the lower place wins. Products and selection are one step, so the square of a batch is never held.
    """
    both = _folded(df, coefs, batch, pos, query, candidate, dims, n_iter, seed, lo, hi)
    rows = batch_best(both, [batch], pos, "_left", "_right", k, largest=False, digits=TIE_DIGITS, offset="_const")
    return rows.withColumnRenamed("best", "found").withColumns(
        {"best": F.get("found", F.lit(0))["place"], "hit": (F.get("found", F.lit(0))["place"] == F.col("member")).cast("int")}
    )


def ranked_candidates(best: DataFrame, hits_only: bool = True) -> DataFrame:
    """The candidates that ``best_candidates`` found as rows ``rank, place, score``."""
    rows = best.filter("hit = 1") if hits_only else best
    keep = [c for c in rows.columns if c not in ("found", "best", "hit")]
    return unnest(rows, keep, "found", "_c", "rank").select("*", "_c.place", "_c.score").drop("_c")


def hits(scored: DataFrame) -> DataFrame:
    """Add ``best`` (the place of the lowest score; the lowest place of equals) and ``hit``."""
    rounded = F.transform("scores", lambda s: F.round(s, TIE_DIGITS))
    best = (F.array_position("_r", F.array_min("_r")) - 1).cast("bigint")
    return (
        scored.withColumn("_r", rounded)
        .withColumn("best", best)
        .withColumn("hit", (F.col("best") == F.col("member")).cast("int"))
        .drop("_r")
    )


def top_candidates(scored: DataFrame, k: int = 3, hits_only: bool = True) -> DataFrame:
    """The best ``k`` candidates per query as rows ``rank, place, score``."""
    rows = hits(scored)
    if hits_only:
        rows = rows.filter("hit = 1")
    best = top_k("scores", k, largest=False, digits=TIE_DIGITS)
    keep = [c for c in rows.columns if c not in ("scores", "best", "hit")]
    return unnest(rows, keep, best, "_c", "rank").select("*", "_c.place", "_c.score").drop("_c")


def accuracy(hit_rows: DataFrame) -> DataFrame:
    """One row: queries and the mean hit flag (null for none)."""
    return hit_rows.agg(F.count("*").alias("n_queries"), F.avg("hit").alias("accuracy"))
