"""Quality classifier: a sparse ensemble of rules over text statistics.

The statistics are Spark columns. On a bounded sample of labelled rows, boosted trees propose rules
(every path from a root is a conjunction of comparisons), a lasso logistic regression keeps few of
them, and the kept rules are compiled into one Spark column expression. Scoring is a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.fitting import Path, boosted_paths, held_out, holds, logistic, training_labels

TRAIN_ROWS = 20_000  # labelled rows that the fit may see
THRESHOLD = 0.3
LASSO = 0.0005

_SPACE = r"[^\x20\x09-\x0D]+"


def _count(pattern: str) -> Column:
    return F.regexp_count(F.col("_text"), F.lit(pattern)).cast("double")


def statistics() -> dict[str, Column]:
    """Statistics of the column ``_text`` (not null), each a number for any text, also an empty one."""
    chars = F.greatest(F.length("_text"), F.lit(1)).cast("double")
    words = F.greatest(_count(_SPACE), F.lit(1.0))
    lines = F.split("_text", "\n")
    # Distinct words among so many draws fall with the length; the root makes lengths comparable.
    distinct = F.size(F.array_distinct(F.split("_text", r"\s+"))).cast("double")
    return {
        "chars": F.log1p(F.length("_text").cast("double")),
        "word_length": chars / words,
        "symbols": _count(r"[#$%&*+<>=^~_{}\[\]\\|@]") / words,
        "symbol_runs": _count(r"[#$%&*+<>=^~_{}\[\]\\|@!?]{2,}") / words,
        "lone_symbols": _count(r"(?<!\S)[^\sA-Za-z0-9\x{80}-\x{10FFFF}]+(?!\S)") / words,
        "repeated_words": _count(r"(?<!\S)(\S+)(?=\s+\1(?!\S))") / words,
        "stops": _count(r"[.!?]") / words,
        "commas": _count(",") / words,
        "digits": _count(r"[0-9]+") / words,
        "capitals": _count(r"[A-Z]+") / words,
        "distinct_words": distinct / words,
        "distinct_root": distinct / F.sqrt(words),
        "line_words": words / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """``id``, ``held_out`` and the statistics of every row; a null text counts as empty."""
    base = docs.select(
        F.col("doc_id").alias("id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    )
    return base.select("id", "held_out", *[c.alias(n) for n, c in statistics().items()])


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: named statistics, rules with weights, and a bias."""

    features: tuple[str, ...]
    rules: tuple[tuple[Path, float], ...]
    bias: float

    def column(self) -> Column:
        """The score as one Spark expression over the statistics."""
        total = F.lit(self.bias)
        for path, weight in self.rules:
            tests = [
                (F.col(self.features[f]) > F.lit(t)) if above else (F.col(self.features[f]) <= F.lit(t))
                for f, above, t in path
            ]
            all_hold = tests[0]
            for test in tests[1:]:
                all_hold = all_hold & test
            total = total + F.when(all_hold, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def text(self) -> list[str]:
        """The rules as readable lines, the heaviest first."""
        show = lambda p: " and ".join(f"{self.features[f]} {'>' if a else '<='} {t:.4g}" for f, a, t in p)
        return [f"{w:+.3f}  {show(p)}" for p, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> Rules:
    """Fit on at most ``rows`` labelled rows; only their statistics reach the driver.

    Without usable labels the score is a constant half; with one class it is near that class.
    """
    names = tuple(statistics())
    wanted = F.broadcast(training_labels(labels, column, rows))  # at most ``rows`` ids
    sample = with_statistics(docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    # Of several rows of one id the smallest statistics count, so there are at most ``rows``, the same in every run.
    per_id = sample.groupBy("id").agg(F.min(F.struct(*names)).alias("s")).select("id", "s.*")
    table = per_id.join(wanted, "id").orderBy("id").select("y", *names).toArrow()
    if not table.num_rows:
        return Rules(names, (), 0.0)
    x = np.column_stack([table[n].to_numpy() for n in names])
    y = table["y"].to_numpy()
    paths = boosted_paths(x, y)
    if not paths:
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(names, (), float(np.log(share / (1 - share))))
    hold = np.column_stack([holds(p, x) for p in paths])
    weights, bias = logistic(hold, y, l1=LASSO)
    kept = np.flatnonzero(weights)
    # The lasso chooses; a refit of the chosen rules undoes its shrinkage.
    weights, bias = logistic(hold[:, kept], y, steps=800) if len(kept) else (weights[kept], bias)
    return Rules(names, tuple((paths[i], float(w)) for i, w in zip(kept, weights, strict=True)), bias)


def score(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Only the text is looked at. Null and empty texts get the score of an empty text; ids may be null or
    repeat.
    """
    scored = with_statistics(docs).select("id", "held_out", rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
