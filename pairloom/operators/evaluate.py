"""String quality of (target, pred) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.util import as_col, let
from pairloom.operators.rows import unnest, unnest_structs
from pairloom.session import place


LETTERS = 500_000  # of one partition of pairs, whose grams meet in the memory of one task


def _default_normal(text: Column) -> Column:
    return F.lower(F.trim(text))


def exact_flag(normalize=_default_normal) -> Column:
    """1 where both sides convert to the same value; a side that converts to null never matches."""
    same = normalize(F.col("target")) == normalize(F.col("pred"))
    return F.coalesce(same, F.lit(False)).cast("int")


def exact_match(df: DataFrame, normalize=_default_normal) -> DataFrame:
    """One row: pairs, exact pairs, and their share of all pairs, invalid ones included."""
    return df.select(exact_flag(normalize).alias("e")).agg(
        F.count("*").alias("n_pairs"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_exact"),
        F.avg("e").alias("exact_match"),
    )


def edit_distance(df: DataFrame) -> DataFrame:
    """Add ``lev``, the edit distance in characters."""
    return df.withColumn("lev", F.levenshtein("target", "pred"))


def _grams(text: Column | str, n: int) -> Column:
    """All n-grams of a text as an array of strings, from its characters."""
    return let(
        F.filter(F.split(as_col(text), ""), lambda ch: ch != ""),
        lambda chars: F.when(
            F.size(chars) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))),
                lambda i: F.concat(*[F.get(chars, i + (k - 1)) for k in range(n)]),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def gram_counts(df: DataFrame, key: str, sizes: list[int], marks: dict[str, Column] | None = None) -> DataFrame:
    """``key, n, gram, in_target, in_pred``: how often each gram is on each side.

    The texts are placed by ``key`` before they are taken apart, so only raw text is shuffled and
    the counts of both sides and all sizes form where the pair is, in one aggregation and no join.
    A gram is put together from the characters behind its place; cutting it out of the text would
    walk the text from its start for every gram.

    The number of partitions follows the number of letters, counted first, so what a task holds does not grow with the table.

    ``marks`` are numbers of a pair, from ``target`` and ``pred``. With them every pair, also one without any gram, has
    one more row with null ``n`` and ``gram`` that carries them; they are null in all others.
    """
    marks = marks or {}

    def side(name: str, a: int, b: int) -> Column:
        return F.struct(F.split(name, "").alias("chars"), F.lit(a).alias("a"), F.lit(b).alias("b"))

    def gram(n: int) -> Column:
        letters = [F.get("chars", (F.col("at") + k).cast("int")) for k in range(1, n)]
        # Beyond the end a letter is null, and so is the gram.
        return F.struct(F.lit(n).alias("n"), F.concat("letter", *letters).alias("gram"))

    # Only the pair's own row of the three carries the marks.
    own = F.col("a").isNull()
    lengths = [F.coalesce(F.length(c), F.lit(0)).cast("long") for c in ("target", "pred")]
    letters = df.agg(F.sum(lengths[0] + lengths[1])).first()[0] or 0
    placed = place(df.select(key, "target", "pred"), key, least=-(-letters // LETTERS)).select("*", *[v.alias(f"_{m}") for m, v in marks.items()])
    held = [F.when(own, F.col(f"_{m}")).alias(f"_{m}") for m in marks]
    blank = F.struct(F.array(F.lit("")).alias("chars"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    three = F.array(side("target", 1, 0), side("pred", 0, 1), *([blank] if marks else []))
    sides = unnest_structs(placed, [key, *[f"_{m}" for m in marks]], three, "chars").select(key, "chars", "a", "b", *held)
    rest = ["a", "b", *[f"_{m}" for m in marks]]
    letters = unnest(sides, [key, "chars", *rest], "chars", "letter", "at").filter(own | (F.col("letter") != ""))
    null = F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("gram"))
    some = F.array(*[gram(n) for n in sizes])
    grams = letters.select(key, *rest, F.inline_outer(F.when(own, F.array(null)).otherwise(some) if marks else some))
    grams = grams.filter(own | F.col("gram").isNotNull())
    return grams.groupBy(key, "n", "gram").agg(
        F.sum("a").alias("in_target"), F.sum("b").alias("in_pred"), *[F.max(f"_{m}").alias(m) for m in marks]
    )


def _lengths(sizes: list[int]) -> dict[str, Column]:
    """What the brevity and the precisions of BLEU need of a pair besides its grams."""
    return {"target_len": F.length("target"), "pred_len": F.length("pred")} | {
        f"total_{n}": F.greatest(F.length("pred") - n + 1, F.lit(1)) for n in sizes
    }


def _matches(sizes: list[int]) -> list[Column]:
    both = F.least("in_target", "in_pred")
    return [F.coalesce(F.sum(F.when(F.col("n") == n, both)), F.lit(0)).alias(f"match_{n}") for n in sizes]


def _bleu(row: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``bleu`` to a row of matches, totals and lengths."""
    none = F.lit(False)
    logs = F.lit(0.0)
    for n in sizes:
        none = none | (F.col(f"match_{n}") == 0)
        share = F.greatest(F.col(f"match_{n}"), F.lit(1)) / F.col(f"total_{n}")
        logs = logs + F.log(share) / len(sizes)
    brevity = F.when(F.col("pred_len") > F.col("target_len"), F.lit(1.0)).otherwise(
        F.exp(1.0 - F.try_divide(F.col("target_len"), F.col("pred_len")))
    )
    return row.withColumn("bleu", F.when(none, F.lit(0.0)).otherwise(brevity * F.exp(logs)))


def corpus_bleu(df: DataFrame, key: str, max_n: int = 4) -> DataFrame:
    """One row: character BLEU of the whole corpus, one reference per pair, equal weights.

    Matches and lengths are summed over the corpus before the precisions are formed, both from one gram table. An order
    without a match gives 0.
    """
    sizes = list(range(1, max_n + 1))
    lengths = _lengths(sizes)
    row = gram_counts(df, key, sizes, lengths).agg(*_matches(sizes), *[F.sum(m).alias(m) for m in lengths])
    return _bleu(row, sizes)


def gram_bits(text: Column | str, n: int, bits: int) -> Column:
    """Fingerprint: the set of hashed n-grams, each a number below ``bits``."""
    distinct = F.array_distinct(_grams(text, n))
    slots = F.transform(
        distinct, lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % bits).cast("int")
    )
    return F.array_distinct(slots)


def set_tanimoto(n: int = 3, bits: int = 2048) -> Column:
    """Shared over all fingerprint bits of ``target`` and ``pred`` (0 where both are empty)."""
    sides = F.array(gram_bits("target", n, bits), gram_bits("pred", n, bits))

    def share(s: Column) -> Column:
        both = F.size(F.array_intersect(s[0], s[1]))
        return F.coalesce(F.try_divide(both, F.size(s[0]) + F.size(s[1]) - both), F.lit(0.0))

    return let(sides, share)


def tanimoto_set(df: DataFrame, n: int = 3, bits: int = 2048) -> DataFrame:
    """Add ``tanimoto``: shared over all fingerprint bits of the pair (0 where both are empty)."""
    return df.withColumn("tanimoto", set_tanimoto(n, bits))


def _shared_counts(n: int) -> Column:
    """The Tanimoto value of a pair's gram counts, as an aggregate over its rows of the gram table (0 without a gram)."""
    mine = F.col("n") == n
    both = F.sum(F.when(mine, F.least("in_target", "in_pred")))
    every = F.sum(F.when(mine, F.col("in_target") + F.col("in_pred")))
    return F.coalesce(both / (every - both), F.lit(0.0))


def tanimoto_count(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Per pair: shared over all gram counts. Pairs without a gram on either side get 0."""
    grams = gram_counts(df, key, [n], {"pair": F.lit(1)})
    return grams.groupBy(key).agg(_shared_counts(n).alias("tanimoto"))


def pair_validity(df: DataFrame, is_valid) -> DataFrame:
    """One row: the share of pairs with two valid sides. ``is_valid`` maps a Column to a Column."""
    both = F.coalesce(is_valid(F.col("target")) & is_valid(F.col("pred")), F.lit(False))
    return df.select(both.cast("int").alias("v")).agg(
        F.count("*").alias("n_pairs"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_valid"),
        F.avg("v").alias("validity"),
    )


def pair_report(df: DataFrame, key: str, is_valid, normalize=_default_normal, more: list[str] | None = None) -> DataFrame:
    """Per pair: both strings, ``exact``, ``valid`` and ``lev`` (and the columns ``more``), in one pass
    without a shuffle."""
    both = F.coalesce(is_valid(F.col("target")) & is_valid(F.col("pred")), F.lit(False))
    return df.select(
        key,
        F.col("target").alias("ground_truth"),
        F.col("pred").alias("prediction"),
        (exact_flag(normalize) * both.cast("int")).alias("exact"),
        both.cast("int").alias("valid"),
        F.levenshtein("target", "pred").alias("lev"),
        *(more or []),
    )


def pair_summary(df: DataFrame, key: str, is_valid, normalize=_default_normal, n: int = 3, max_n: int = 4) -> DataFrame:
    """One row: pairs, BLEU, exact match, mean edit distance, validity, and the means of both Tanimoto kinds
    over the pairs with two valid sides (null without any).

    The pairs are built and placed once; their flags ride with their own row of the gram table, which is rolled up to pairs
    and then to the corpus. ``key`` must be unique.
    """
    sizes = sorted({*range(1, max_n + 1), n})
    orders = list(range(1, max_n + 1))
    lengths = _lengths(orders)
    valid = F.coalesce(is_valid(F.col("target")) & is_valid(F.col("pred")), F.lit(False)).cast("int")
    flags = {"exact": exact_flag(normalize) * valid, "valid": valid, "lev": F.levenshtein("target", "pred"), "tanimoto": set_tanimoto(n)}
    pairs = (
        gram_counts(df, key, sizes, flags | lengths)
        .groupBy(key)
        .agg(*_matches(orders), _shared_counts(n).alias("counted"), *[F.max(m).alias(m) for m in flags | lengths])
    )
    row = pairs.agg(
        F.count("*").alias("n_pairs"),
        F.avg(F.when(F.col("valid") == 1, F.col("tanimoto"))).alias("mean_tanimoto_set"),
        F.avg("exact").alias("exact_match"),
        F.avg("lev").alias("mean_lev"),
        F.avg("valid").alias("validity"),
        F.avg(F.when(F.col("valid") == 1, F.col("counted"))).alias("mean_tanimoto_count"),
        *[F.sum(c).alias(c) for c in (*lengths, *(f"match_{n}" for n in orders))],
    )
    return _bleu(row, orders).select(
        "n_pairs", "mean_tanimoto_set", "exact_match", "mean_lev", "validity", "mean_tanimoto_count", "bleu"
    )


def evaluate_pairs(df: DataFrame, key: str, is_valid, normalize=_default_normal) -> tuple[DataFrame, DataFrame]:
    """The per-pair report and the one-row summary."""
    return pair_report(df, key, is_valid, normalize), pair_summary(df, key, is_valid, normalize)
