"""Small models fitted in numpy on a bounded sample: boosted trees, lasso and ridge logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str = "doc_id", folds: int = FOLDS) -> Column:
    """True for the rows whose labels are never learned from: crc32 of the id as text is 0 modulo ``folds``.

    A null id has no remainder; such a row counts as held out.
    """
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """``id``, ``y`` of at most ``rows`` labelled ids outside the held-out part, by a hash of the id.

    Ids with several labels take the largest; null labels and ids are left out.
    """
    kept = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    per_id = kept.groupBy(F.col("doc_id").alias("id")).agg(F.max(column).cast("double").alias("y"))
    return per_id.orderBy(F.xxhash64("id"), "id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient; ``l1`` sets small weights to zero."""
    rows, width = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights = np.zeros(width + 1)
    weights[-1] = np.log(share / (1 - share))
    full = np.column_stack((x, np.ones(rows)))
    # The largest singular value from the small product: no further copy of all rows.
    step = 4 / (np.linalg.eigvalsh(full.T @ full)[-1] / rows + 4 * l2)
    ahead, momentum = weights.copy(), 1.0
    for _ in range(steps):
        gradient = full.T @ (sigmoid(full @ ahead) - y) / rows
        gradient[:-1] += l2 * ahead[:-1]
        new = ahead - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / grown * (new - weights)
        weights, momentum = new, grown
    return weights[:-1], float(weights[-1])


Path = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all of which hold


def _best_split(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, leaf: int):
    best = (1e-6, None, None)
    total_g, total_w = gradient.sum(), weight.sum()
    base = total_g**2 / (total_w + 1)
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        bins = len(edges) + 1
        g = np.cumsum(np.bincount(codes[:, f], gradient, bins))[:-1]
        w = np.cumsum(np.bincount(codes[:, f], weight, bins))[:-1]
        n = np.cumsum(np.bincount(codes[:, f], minlength=bins))[:-1]
        gain = g**2 / (w + 1) + (total_g - g) ** 2 / (total_w - w + 1) - base
        gain[(n < leaf) | (len(codes) - n < leaf)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], f, i)
    return best[1:]


def boosted_paths(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, leaf: int = 10) -> list[Path]:
    """Paths from the root to every node of boosted trees, each once.

    A path is a conjunction: features above (``True``) or at most (``False``) a threshold.
    """
    cuts = [np.unique(np.quantile(column, np.linspace(0.005, 0.995, 100), method="lower")) for column in x.T]
    cuts = [c[c < column.max()] for c, column in zip(cuts, x.T, strict=True)]
    codes = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    paths: dict[Path, None] = {}
    raw = np.full(len(y), np.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(y.mean(), 1e-3, 1 - 1e-3))))
    for _ in range(trees):
        p = sigmoid(raw)
        gradient, weight = y - p, p * (1 - p)
        nodes: list[tuple[np.ndarray, Path]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            following = []
            for rows, path in nodes:
                f, i = _best_split(codes[rows], cuts, gradient[rows], weight[rows], leaf) if level < depth else (None, None)
                if f is None:
                    raw[rows] += rate * gradient[rows].sum() / (weight[rows].sum() + 1)
                    continue
                above = codes[rows, f] > i
                for side in (False, True):
                    more = (*path, (f, side, float(cuts[f][i])))
                    paths[tuple(sorted(set(more)))] = None
                    following.append((rows[above == side], more))
            nodes = following
    return list(paths)


def holds(path: Path, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, threshold in path:
        out &= (x[:, f] > threshold) == above
    return out
