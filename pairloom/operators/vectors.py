"""Similarity, soft targets, contrastive loss with a memory bank, moving average, Fréchet distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.util import as_col, let
from pairloom.operators.blocks import batch_best, batch_products, matrix
from pairloom.operators.rows import unnest
from pairloom.operators.stretches import DEPTH, STRETCH, TIE, cut_stretches
from pairloom.session import place

# The range that the temperature is held in.
TEMP_MIN, TEMP_MAX = 0.07, 0.5


def clamp_temp(temp: float) -> float:
    return min(max(temp, TEMP_MIN), TEMP_MAX)


def ramp_alpha(alpha: float, epoch: int, batch_no: int, n_batches: int) -> float:
    """Linear growth over epoch 0, constant after it."""
    return alpha if epoch > 0 else alpha * min(1.0, batch_no / n_batches)


def similarity(df: DataFrame, batch: list[str], order: str, a: str, b: str) -> DataFrame:
    """Dot products between view ``a`` of a row and view ``b`` of every row of its batch."""
    return batch_products(df, batch, order, a, b).withColumnRenamed("products", "sim")


def nearest(
    df: DataFrame, batch: list[str], order: str, a: str, b: str, k: int, largest: bool = True, digits: int = 9
) -> DataFrame:
    """The first ``k`` of ``similarity``, as ``top_k`` selects them, in ``best``; the square of a batch is never held."""
    return batch_best(df, batch, order, a, b, k, largest, digits)


def top_k(scores: Column | str, k: int, largest: bool = True, digits: int = 9) -> Column:
    """The best ``k`` places of a score array as structs ``(place, score)``.

    Scores that agree to ``digits`` places are ties, and the lower place wins; without that the
    last bit of a sum would decide between two copies of a row.
    """
    sign = -1.0 if largest else 1.0
    keyed = F.transform(
        as_col(scores),
        lambda s, i: F.struct(
            F.round(s * sign, digits).alias("rank"), i.cast("bigint").alias("place"), s.alias("score")
        ),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k), lambda e: F.struct(e["place"], e["score"])
    )


def softmax(scores: Column | str, temp: float) -> Column:
    return let(
        F.array_max(as_col(scores)),
        lambda top: let(
            F.transform(as_col(scores), lambda s: F.exp((s - top) / temp)),
            lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
                lambda z: F.transform(e, lambda v: v / z),
            ),
        ),
    )


def soft_targets(sim: Column | str, own: Column | str, temp: float, alpha: float) -> Column:
    """``alpha * softmax(sim / temp) + (1 - alpha) * [own place]``."""
    own = as_col(own)
    return F.transform(
        softmax(sim, clamp_temp(temp)),
        lambda p, i: alpha * p + F.when(i == own, F.lit(1.0 - alpha)).otherwise(F.lit(0.0)),
    )


def _bank_steps(q: int, per_step: int) -> int:
    if q % per_step:
        raise ValueError("the bank size must be a multiple of the rows that enter per step")
    return q // per_step


def bank_blocks(
    df: DataFrame, batch: str, member: str, q: int, per_step: int = 64, min_block: int = 16
) -> DataFrame:
    """Bring every batch together with the bank before it, by an equi-join key ``block``.

    A block is a run of at least ``q / per_step`` batches, so the bank of each of its batches lies
    in the block itself and in the end of the block before. Only those rows are sent twice; a
    range join would send each row once per batch that sees it.
    """
    steps = _bank_steps(q, per_step)
    length = max(steps, min_block)
    own = F.floor(F.col(batch) / length)
    seen_later = (F.col(batch) % length >= length - steps) & (F.col(member) < per_step)
    return df.withColumn("_home", own).withColumn(
        "block", F.explode(F.when(seen_later, F.array(own, own + 1)).otherwise(F.array(own)))
    )


def memory_bank(df: DataFrame, batch: str, member: str, q: int, per_step: int = 64) -> DataFrame:
    """Per batch: its rows, the rows of its bank, the first batch in the bank, all candidates."""
    steps = _bank_steps(q, per_step)
    sizes = df.groupBy(batch).agg(
        F.count("*").alias("rows"), F.count_if(F.col(member) < per_step).alias("entered")
    )
    blocks = bank_blocks(sizes.withColumn("_zero", F.lit(0)), batch, "_zero", q, per_step)
    before = Window.partitionBy("block").orderBy(batch).rangeBetween(-steps, -1)
    return (
        blocks.withColumns(
            {
                "bank_rows": F.coalesce(F.sum("entered").over(before), F.lit(0)),
                "bank_from": F.min(batch).over(before),
            }
        )
        .filter("block = _home")
        .select(
            batch, "rows", "bank_rows", "bank_from", (F.col("rows") + F.col("bank_rows")).alias("candidates")
        )
    )


CHUNK_BATCHES = 32  # batches of a chunk of queries or candidates
_BOTH, _QUERY, _BANK = 0, 1, 2  # what a row is in a pair of chunks
_PARTS = "query_chunk bigint, batch_no bigint, rows bigint, candidates bigint, parts array<double>"
_STATE = 6  # numbers of a partial sum


def _partial_sums(logits: np.ndarray, soft: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What one chunk of candidates adds to the loss of each query (rows): the maximum and the sum of exponentials of the
    logits, the same of the soft scores, the logits weighted by the latter, and the query's own logit."""
    top, high = logits.max(axis=1), soft.max(axis=1)
    weights = np.exp(soft - high[:, None])
    return np.column_stack((top, np.exp(logits - top[:, None]).sum(axis=1), high, weights.sum(axis=1), (weights * logits).sum(axis=1), own))


def _merged_loss(parts: np.ndarray, alpha: float) -> float:
    """The mean loss of queries from their partial sums (chunk, query, number), each relative to its own maximum."""
    top, high = parts[:, :, 0].max(axis=0), parts[:, :, 2].max(axis=0)
    log_sum = top + np.log((parts[:, :, 1] * np.exp(parts[:, :, 0] - top)).sum(axis=0))
    scale = np.exp(parts[:, :, 2] - high)
    expected = (parts[:, :, 4] * scale).sum(axis=0) / (parts[:, :, 3] * scale).sum(axis=0)
    own = np.nanmax(parts[:, :, 5], axis=0)  # one chunk has it
    return float((log_sum - alpha * expected - (1.0 - alpha) * own).mean())


def contrastive_loss(
    df: DataFrame,
    batch: str,
    member: str,
    view1: str,
    view2: str,
    q: int,
    temp: float,
    alpha: float,
    per_step: int = 64,
    ramp_batches: int | None = None,
    live1: str | None = None,
    live2: str | None = None,
) -> DataFrame:
    """Per batch: both directions of the contrastive loss against own batch and bank.

    ``view1`` and ``view2`` are the momentum features: they fill the pools and the bank and give the soft
    targets. The logits' query side are the live features ``live1`` and ``live2``, the same columns if not given.
    ``alpha`` grows over ``ramp_batches`` batches where that is given (epoch 0).

    Queries and candidates meet by pairs of chunks of CHUNK_BATCHES batches. A pair gives each query a partial softmax: a maximum,
    sums relative to it, and expected logits. The partial sums of a query's chunks are merged, so no task ever
    holds a whole bank, and what a row is sent to grows with the bank in chunks only.
    """
    temp = clamp_temp(temp)
    steps = _bank_steps(q, per_step)
    reach = -(-steps // CHUNK_BATCHES)  # chunks behind its own that a batch's bank lies in

    def meet(pair: pa.Table) -> pa.Table:
        pair = pair.sort_by([("batch_no", "ascending"), ("member", "ascending")])
        role = pair["role"].to_numpy()
        asked, offered = pair.filter(pa.array(role != _BANK)), pair.filter(pa.array(role != _QUERY))
        at, pool_at = asked["batch_no"].to_numpy(), offered["batch_no"].to_numpy()
        entered = offered["member"].to_numpy() < per_step
        v1, v2, l1, l2 = (matrix(asked[c], asked.num_rows) for c in ("v1", "v2", "l1", "l2"))
        p1, p2 = (matrix(offered[c], offered.num_rows) for c in ("v1", "v2"))
        chunk = pair["query_chunk"][0].as_py()
        home = chunk == pair["pool_chunk"][0].as_py()
        out: list[tuple] = []
        for b in np.unique(at):
            mine = slice(np.searchsorted(at, b), np.searchsorted(at, b, side="right"))
            here = slice(np.searchsorted(pool_at, b), np.searchsorted(pool_at, b, side="right"))
            bank = np.arange(np.searchsorted(pool_at, b - steps), here.start)
            pool = np.concatenate((np.arange(here.start, here.stop) if home else bank[:0], bank[entered[bank]]))
            if not len(pool):
                continue
            sums = []
            for live, query, candidates in ((l2, v2, p1), (l1, v1, p2)):
                logits = live[mine] @ candidates[pool].T / temp
                own = np.diagonal(logits) if home else np.full(len(logits), np.nan)
                sums.append(_partial_sums(logits, query[mine] @ candidates[pool].T / temp, own))
            out.append((chunk, int(b), len(sums[0]), len(pool), np.stack(sums).ravel()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        names = ["query_chunk", "batch_no", "rows", "candidates", "parts"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def merge(found: pa.Table) -> pa.Table:
        found = found.sort_by("batch_no")
        at = found["batch_no"].to_numpy()
        out: dict[str, list] = {"batch_no": [], "candidates": [], "loss": []}
        for b in np.unique(at):
            mine = found.slice(np.searchsorted(at, b), int((at == b).sum()))
            parts = np.array(mine["parts"].to_pylist()).reshape(mine.num_rows, 2, -1, _STATE)
            a = alpha if ramp_batches is None else alpha * min(1.0, b / ramp_batches)
            out["batch_no"].append(int(b))
            out["candidates"].append(sum(mine["candidates"].to_pylist()))
            out["loss"].append(_merged_loss(parts[:, 0], a) + _merged_loss(parts[:, 1], a))
        types = {"batch_no": pa.int64(), "candidates": pa.int64(), "loss": pa.float64()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    rows = df.select(
        F.col(batch).cast("bigint").alias("batch_no"),
        F.col(member).cast("bigint").alias("member"),
        F.col(view1).cast("array<double>").alias("v1"),
        F.col(view2).cast("array<double>").alias("v2"),
        F.col(live1 or view1).cast("array<double>").alias("l1"),
        F.col(live2 or view2).cast("array<double>").alias("l2"),
    )
    chunk = F.floor(F.col("batch_no") / CHUNK_BATCHES)

    def to(query_chunk: Column, pool_chunk: Column, role: int, wanted: Column = F.lit(True)) -> Column:
        return F.when(wanted, F.struct(query_chunk.alias("query_chunk"), pool_chunk.alias("pool_chunk"), F.lit(role).alias("role")))

    places = [to(chunk, chunk, _BOTH)]
    for d in range(1, reach + 1):
        reaches = (chunk >= d) & (F.col("batch_no") - steps < (chunk - d + 1) * CHUNK_BATCHES)
        seen = (F.col("member") < per_step) & ((chunk + d) * CHUNK_BATCHES - steps <= F.col("batch_no"))
        places += [to(chunk, chunk - d, _QUERY, reaches), to(chunk + d, chunk, _BANK, seen)]
    sent = rows.withColumn("_to", F.explode(F.array_compact(F.array(*places)))).select("_to.*", *rows.columns)
    # The bank is asked with momentum features only.
    for c in ("l1", "l2"):
        sent = sent.withColumn(c, F.when(F.col("role") != _BANK, F.col(c)))
    partial = place(sent, "query_chunk", "pool_chunk").groupBy("query_chunk", "pool_chunk").applyInArrow(meet, _PARTS)
    return partial.groupBy("query_chunk").applyInArrow(merge, "batch_no bigint, candidates bigint, loss double")


def ema(
    df: DataFrame, keys: list[str], order: str, value: str, decay: float, ties: list[str] | None = None, depth: int = DEPTH
) -> DataFrame:
    """Last value of ``m <- decay * m + (1 - decay) * x`` per key, started at the first ``x``.

    Rows come by ``order``, equal values by a hash of ``ties`` (all columns if not given), those without an order last.
    A series with a large share of the rows is cut in stretches of equal size. Each stretch gives one weighted sum; the number
    of later rows moves that sum to the end of the series. So one long series is spread over many tasks, and no term is left out.
    """
    cut = cut_stretches(df.withColumn("_x", F.col(value).cast("double")), keys, order, ties, depth)
    cut = cut.select(*keys, order, "_x", TIE, F.coalesce(STRETCH, F.lit(0)).alias(STRETCH))
    place = Window.partitionBy(*keys, STRETCH)
    later = F.row_number().over(place.orderBy(F.desc_nulls_first(order), F.desc(TIE))) - 1
    stretches = (
        cut.withColumn("_later", later)
        .groupBy(*keys, STRETCH)
        .agg(
            F.count("*").alias("_n"),
            F.sum(F.col("_x") * F.pow(F.lit(decay), F.col("_later"))).alias("_s"),
            F.max_by("_x", "_later").alias("_head"),
        )
    )
    after = Window.partitionBy(*keys).orderBy(F.desc(STRETCH)).rowsBetween(Window.unboundedPreceding, -1)
    moved = stretches.withColumn("_after", F.coalesce(F.sum("_n").over(after), F.lit(0)))
    return (
        moved.groupBy(*keys)
        .agg(
            F.sum("_n").alias("n"),
            F.min_by("_head", STRETCH).alias("_first"),
            F.sum(F.col("_s") * F.pow(F.lit(decay), F.col("_after"))).alias("_sum"),
        )
        .select(
            *keys,
            "n",
            (
                F.pow(F.lit(decay), F.col("n")) * F.col("_first") + (1.0 - decay) * F.col("_sum")
            ).alias("ema"),
        )
    )


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred sum of outer products of two sets together."""
    (n, mean, spread), (m, other, more) = a, b
    shift = other - mean
    total = n + m
    return total, mean + shift * (m / total), spread + more + np.outer(shift, shift) * (n * m / total)


def _moment_rows(parts: dict[str, tuple], lot: int) -> pa.RecordBatch:
    names = list(parts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array([lot] * len(names), pa.int64()),
            pa.array([int(parts[g][0]) for g in names], pa.int64()),
            pa.array([parts[g][1].tolist() for g in names], pa.list_(pa.float64())),
            pa.array([parts[g][2].ravel().tolist() for g in names], pa.list_(pa.float64())),
        ],
        names=["grp", "lot", "n", "mean", "spread"],
    )


_MOMENTS = "grp string, lot bigint, n bigint, mean array<double>, spread array<double>"
LOTS = 256
HELD = 64 << 20  # bytes of matrices that a task holds


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of one task, per group, centred on the mean of each batch and merged.

    Where there are so many groups that their matrices would not fit, those at hand are sent on and later rows of a group start anew.
    """
    lot = TaskContext.get().partitionId() % LOTS
    parts: dict[str, tuple] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = matrix(batch.column("vec"), batch.num_rows)
        most = max(1, HELD // (8 * max(1, x.shape[1]) ** 2))
        coded = batch.column("grp").dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        edges = np.flatnonzero(np.diff(codes[order])) + 1
        for rows in np.split(order, edges):
            g, some = coded.dictionary[codes[rows[0]]].as_py(), x[rows]
            if g not in parts and len(parts) >= most:
                yield _moment_rows(parts, lot)
                parts = {}
            mean = some.mean(axis=0)
            new = (len(some), mean, (some - mean).T @ (some - mean))
            parts[g] = _merged(parts[g], new) if g in parts else new
    if parts:
        yield _moment_rows(parts, lot)


def _merge_moments(table: pa.Table) -> pa.Table:
    merged = None
    for batch in table.select(["n", "mean", "spread"]).to_batches(max_chunksize=64):
        for row in batch.to_pylist():
            d = len(row["mean"])
            new = (row["n"], np.array(row["mean"]), np.array(row["spread"]).reshape(d, d))
            merged = new if merged is None else _merged(merged, new)
    return pa.Table.from_batches([_moment_rows({table["grp"][0].as_py(): merged}, table["lot"][0].as_py())])


def vector_moments(df: DataFrame, vec: str, group: Column | None = None) -> DataFrame:
    """Mean and unbiased covariance per group in long form: ``grp, i, j, n, mean_i, mean_j, cov``.

    Null vectors, and vectors with a null entry, are left out. A task sends one matrix per group it saw, the
    matrices are merged in lots and then once more, and only the result becomes rows. Sums are centred
    before they meet, so a large common offset costs no digits. A task holds matrices of HELD bytes at most, whatever the
    number of groups.
    """
    rows = df.select(
        F.coalesce((F.lit("all") if group is None else group).cast("string"), F.lit("")).alias("grp"),
        F.col(vec).cast("array<double>").alias("vec"),
    ).filter(F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull()))
    partial = rows.mapInArrow(_partial_moments, _MOMENTS)
    lots = partial.groupBy("grp", "lot").applyInArrow(_merge_moments, _MOMENTS)
    whole = lots.groupBy("grp").applyInArrow(_merge_moments, _MOMENTS)
    cells = unnest(whole, ["grp", "n", "mean"], "spread", "xx", "at").withColumns(
        {
            "i": F.floor(F.col("at") / F.size("mean")).cast("int"),
            "j": (F.col("at") % F.size("mean")).cast("int"),
        }
    )
    return cells.select(
        "grp",
        "i",
        "j",
        "n",
        F.get("mean", F.col("i")).alias("mean_i"),
        F.get("mean", F.col("j")).alias("mean_j"),
        F.try_divide("xx", (F.col("n") - 1).cast("double")).alias("cov"),
    )


def frechet_distance(a: DataFrame, b: DataFrame, vec: str) -> DataFrame:
    """``|m1-m2|^2 + tr(C1 + C2 - 2 (C1 C2)^(1/2))`` of two sets of vectors, as one row.

    Only the two d x d tables come together in one task; d is the width of a vector. A side with fewer than
    two vectors has no covariance: the distance is null, or without any vectors there is no row.
    """
    sides = a.select(F.lit("a").alias("_side"), vec).unionByName(b.select(F.lit("b").alias("_side"), vec))
    moments = vector_moments(sides, vec, F.col("_side"))

    def distance(cells: pa.Table) -> pa.Table:
        def side(name: str) -> tuple[np.ndarray, np.ndarray]:
            part = cells.filter(pa.compute.equal(cells["grp"], name)).sort_by(
                [("i", "ascending"), ("j", "ascending")]
            )
            d = int(round(part.num_rows**0.5))
            return (
                part["mean_i"].to_numpy().reshape(d, d)[:, 0],
                part["cov"].to_numpy().reshape(d, d),
            )

        names = set(cells["grp"].to_pylist())
        if names != {"a", "b"} or cells["cov"].null_count:
            return pa.table({"frechet": pa.array([None], pa.float64())})
        (m1, c1), (m2, c2) = side("a"), side("b")
        w, v = np.linalg.eigh(c1)
        root = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
        cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ c2 @ root), 0, None)).sum()
        value = float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2.0 * cross)
        return pa.table({"frechet": pa.array([value], pa.float64())})

    return moments.groupBy(F.lit(0).alias("one")).applyInArrow(distance, "frechet double")
