"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings (GNAT).

Scores are integer inner products. A row x becomes the point (x, sqrt(m - |x|^2)) with the largest squared norm m, an
anchor a the point (a, 0); their squared distance is |a|^2 + m - 2 a.x, so a window of scores is a ring around
the anchor. A node has a few split points, and each row below it goes with the nearest one. For every split point the
node keeps the range of its distances to the rows below every sibling, so one distance from the anchor to a split
point bounds the anchor's distances to all of a sibling's rows: siblings whose bounds miss the ring are out.

The split points come from a bounded sample, the ranges from all rows. Rows lie in blocks by leaf; anchors travel in
packs to the blocks of the leaves that are left, and a pack meets a block in one exact matrix product. A first visit to the
anchor's own leaf narrows the ring for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.components import written

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 10, 100, 256
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
MOVED, LABELS = 7, 10  # ids divisible by MOVED take the next of LABELS labels
SAMPLE = 16_384  # rows that choose the split points; bounds the tree, not the rows in it
FANOUT, CANDIDATES = 8, 24  # split points of a node, chosen among so many sampled rows
LEAF = 4_096  # rows of a leaf that is not split further, while the sample allows
BLOCK_CELLS = 1 << 18  # components of a block of rows
PACK = 256  # anchors that travel together
SLACK = 1e-9  # relative, for rounding of distances: more rows are visited, none is lost
EXACT = float(1 << 53)

ROWS = "id long, label int, cells binary"
BLOCKS = "leaf int, salt int, ids array<array<long>>, labels binary, cells binary"
PACKS = "pack long, ids array<long>, labels binary, cells binary, windows binary"
VISITS = "leaf int, salt int, pack long, slots binary, ids array<long>, labels binary, cells binary, windows binary"
FOUND = "pack long, slot int, window int, anchor long, score long, id long"


def integer_rows(table: DataFrame) -> DataFrame:
    """Rows that take part, once each: ``id``, ``label`` (moved), ``cells`` (32-bit integers floor(SCALE * x))."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            kept = bad[ends] == bad[ends - size]
            values = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0))
            if np.abs(values).max(initial=0) >= 1 << 31:
                raise ValueError(f"a component of {np.abs(values).max() / SCALE} is too large for exact scores")
            whole = values.astype(np.int32)
            cells = [whole[e - n : e].tobytes() for e, n in zip(ends[kept].tolist(), size[kept].tolist(), strict=True)]
            some = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(some), batch.column("label").filter(some), pa.array(cells, pa.binary())],
                names=["id", "label", "cells"],
            )

    label, known = F.col("label").cast("int"), table.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    moved = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    rows = known.select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"), F.col("embedding").alias("vec"))
    return rows.mapInArrow(floors, ROWS).distinct()


def matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(cells), width))
    for row, raw in zip(out, cells, strict=True):
        row[: len(raw) // 4] = np.frombuffer(raw, np.int32)
    return out


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(largest - (x**2).sum(axis=1), 0))))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x @ y.T), 0))


@dataclass
class Node:
    splits: np.ndarray  # lifted split points
    children: list[int]  # a node's number, or ~leaf
    low: np.ndarray = field(default=None)  # [i, j]: least distance of split point i to the rows below child j
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    """Split points and ranges; ``salts`` has the number of blocks by leaf. At most SAMPLE / CANDIDATES nodes."""

    width: int
    largest: float
    rows: int
    nodes: list[Node] = field(default_factory=list)
    salts: list[int] = field(default_factory=list)

    @property
    def block(self) -> int:
        return max(16, BLOCK_CELLS // max(self.width, 1))

    def grow(self, sample: np.ndarray, share: float) -> int:
        """The tree below a part of the sample, which stands for ``share`` of all rows."""
        expected = self.rows * share
        if expected > LEAF and len(sample) > CANDIDATES:
            splits = self._far_apart(sample)
            if len(splits) > 1:
                number = len(self.nodes)
                self.nodes.append(Node(splits, []))
                nearest = distances(sample, splits).argmin(axis=1)
                parts = [sample[nearest == j] for j in range(len(splits))]
                self.nodes[number].children = [self.grow(p, share * len(p) / len(sample)) for p in parts]
                return number
        self.salts.append(max(1, int(np.ceil(expected / self.block))))
        return ~(len(self.salts) - 1)

    def _far_apart(self, sample: np.ndarray) -> np.ndarray:
        """Of the first candidates, one after another the one that is farthest from those chosen."""
        tried = sample[:CANDIDATES]
        chosen = [0]
        gap = distances(tried, tried[:1])[:, 0]
        while len(chosen) < FANOUT and gap.max() > SLACK * np.sqrt(self.largest):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(tried, tried[chosen[-1:]])[:, 0])
        return tried[chosen]

    def leaves(self, points: np.ndarray, ranges: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """The leaf of each point, by the nearest split point; widens ``ranges`` by the distances on the way."""
        leaf = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))] if self.nodes else []
        while todo:
            number, mine = todo.pop()
            node = self.nodes[number]
            away = distances(points[mine], node.splits)
            nearest = away.argmin(axis=1)
            for j, child in enumerate(node.children):
                part = nearest == j
                if not part.any():
                    continue
                if ranges is not None:
                    none = np.full((len(node.splits),) * 2, np.inf)
                    low, high = ranges.setdefault(number, (none, -none))
                    low[:, j] = np.minimum(low[:, j], away[part].min(axis=0))
                    high[:, j] = np.maximum(high[:, j], away[part].max(axis=0))
                if child < 0:
                    leaf[mine[part]] = ~child
                else:
                    todo.append((child, mine[part]))
        return leaf

    def reached(self, anchors: np.ndarray, windows: np.ndarray) -> dict[int, np.ndarray]:
        """Which anchors must visit each leaf. ``windows``: lowest and highest score by anchor and window."""
        points = np.column_stack((anchors, np.zeros(len(anchors))))
        norm = (anchors**2).sum(axis=1)[:, None] + self.largest
        slack = SLACK * norm
        inner = np.sqrt(np.maximum(norm - 2 * windows[:, :, 1] - slack, 0))
        outer = np.sqrt(np.maximum(norm - 2 * windows[:, :, 0] + slack, 0))
        wanted = windows[:, :, 0] <= windows[:, :, 1]
        everyone = np.flatnonzero(wanted.any(axis=1))
        if not self.nodes:
            return {0: everyone}
        found: dict[int, np.ndarray] = {}
        todo = [(0, everyone, np.zeros(len(everyone)), np.full(len(everyone), np.inf))]
        while todo:
            number, mine, least, most = todo.pop()
            node = self.nodes[number]
            away = distances(points[mine], node.splits)
            for j, child in enumerate(node.children):
                lo, hi = node.low[:, j], node.high[:, j]
                if not np.isfinite(hi).all():
                    continue  # no row went there
                a = np.maximum(least, np.maximum(away - hi, lo - away).max(axis=1))
                b = np.minimum(most, (away + hi).min(axis=1))
                meets = (a[:, None] * (1 - SLACK) <= outer[mine]) & (b[:, None] * (1 + SLACK) >= inner[mine]) & wanted[mine]
                on = meets.any(axis=1)
                if child < 0:
                    found[~child] = mine[on]
                elif on.any():
                    todo.append((child, mine[on], a[on], b[on]))
        return found


def plant(points: DataFrame) -> Tree:
    """A tree whose split points come from the ``SAMPLE`` rows of smallest hash."""
    stats = points.agg((F.max(F.length("cells")) / 4).cast("int"), F.max("norm"), F.count("*")).first()
    tree = Tree(max(stats[0] or 0, 1), float(stats[1] or 0), stats[2])
    if tree.largest >= EXACT:
        raise ValueError("vectors are too long for exact scores in double precision")
    rows = points.select("cells", F.xxhash64("cells", "label").alias("h")).orderBy("h", "cells").limit(SAMPLE).collect()
    tree.grow(lift(matrix([bytes(r["cells"]) for r in rows], tree.width), tree.largest), 1.0)
    return tree


def pack_blocks(points: DataFrame, tree: Tree) -> DataFrame:
    """All rows in blocks by leaf, as a written table."""
    salts = np.array(tree.salts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(lift(matrix(batch.column("cells").to_pylist(), tree.width), tree.largest))
            salt = (np.asarray(batch.column("h")) % salts[leaf]).astype(np.int32)
            columns = [pa.array(leaf, pa.int32()), pa.array(salt, pa.int32()), *(batch.column(c) for c in ("ids", "label", "cells"))]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "salt", "ids", "label", "cells"])

    def block(rows: pa.Table) -> pa.Table:
        parts = [rows.slice(at, tree.block) for at in range(0, rows.num_rows, tree.block)]
        columns = [
            [p["leaf"][0].as_py() for p in parts],
            [p["salt"][0].as_py() for p in parts],
            [p["ids"].to_pylist() for p in parts],
            [np.asarray(p["label"]).astype(np.int32).tobytes() for p in parts],
            [matrix(p["cells"].to_pylist(), tree.width).astype(np.int32).tobytes() for p in parts],
        ]
        types = (pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary())
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["leaf", "salt", "ids", "labels", "cells"]
        )

    hashed = points.withColumn("h", F.xxhash64("cells", "label"))
    placed = hashed.mapInArrow(place, "leaf int, salt int, ids array<long>, label int, cells binary")
    return written(placed.groupBy("leaf", "salt").applyInArrow(block, BLOCKS), "blocks")


def measure(blocks: DataFrame, tree: Tree) -> None:
    """Fill the ranges of the tree from all rows: each task sends one row per node."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for cells in batch.column("cells"):
                x = np.frombuffer(cells.as_py(), np.int32).reshape(-1, tree.width).astype(np.float64)
                tree.leaves(lift(x, tree.largest), ranges)
        numbers = list(ranges)
        columns = [numbers, [ranges[n][0].ravel() for n in numbers], [ranges[n][1].ravel() for n in numbers]]
        types = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "low", "high"])

    if not tree.nodes:
        return
    parts = blocks.select("cells").mapInArrow(widen, "node int, low array<double>, high array<double>")
    entries = parts.select("node", F.posexplode(F.arrays_zip("low", "high")).alias("at", "v"))
    bounds = entries.groupBy("node", "at").agg(F.min("v.low").alias("low"), F.max("v.high").alias("high"))
    for node in tree.nodes:
        node.low, node.high = (np.full((len(node.splits),) * 2, s * np.inf) for s in (1, -1))
    for r in bounds.collect():  # FANOUT^2 rows per node
        tree.nodes[r["node"]].low.flat[r["at"]] = r["low"]
        tree.nodes[r["node"]].high.flat[r["at"]] = r["high"]


def pack_anchors(anchors: DataFrame, count: int, tree: Tree) -> DataFrame:
    """Anchors in packs, all with one window that takes every score."""
    parts = max(1, -(-count // PACK))

    def pack(rows: pa.Table) -> pa.Table:
        number = rows["part"][0].as_py() << 20
        parts = [rows.slice(at, PACK) for at in range(0, rows.num_rows, PACK)]
        everything = np.array([[-(1 << 53), 1 << 53]], np.int64)
        columns = [
            [number + i for i in range(len(parts))],
            [p["id"].to_pylist() for p in parts],
            [np.asarray(p["label"]).astype(np.int32).tobytes() for p in parts],
            [matrix(p["cells"].to_pylist(), tree.width).astype(np.int32).tobytes() for p in parts],
            [np.repeat(everything, p.num_rows, axis=0).tobytes() for p in parts],
        ]
        return _table(columns, PACKS)

    parted = anchors.withColumn("part", F.pmod(F.xxhash64("id", "label", "cells"), F.lit(parts)))
    return written(parted.groupBy("part").applyInArrow(pack, PACKS), "packs")


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _table(columns: list, schema: str) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    arrays = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _unpacked(row: dict, width: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels, vectors and windows of a pack."""
    ids = row["ids"]
    cells = np.frombuffer(row["cells"], np.int32).reshape(len(ids), width).astype(np.float64)
    return ids, np.frombuffer(row["labels"], np.int32), cells, np.frombuffer(row["windows"], np.int64).reshape(len(ids), -1, 2)


def visits(packs: DataFrame, tree: Tree, home: bool) -> DataFrame:
    """One row per pack and block to visit: the anchors' own leaves, or all others that their windows reach."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x, windows = _unpacked(row, tree.width)
                own = tree.leaves(np.column_stack((x, np.zeros(len(x)))))
                if home:
                    going = {leaf: np.flatnonzero(own == leaf) for leaf in np.unique(own).tolist()}
                else:
                    going = {leaf: some[own[some] != leaf] for leaf, some in tree.reached(x, windows).items()}
                for leaf, some in going.items():
                    if len(some):
                        data = (
                            some.astype(np.int32).tobytes(), [ids[i] for i in some], labels[some].tobytes(),
                            x[some].astype(np.int32).tobytes(), windows[some].tobytes(),
                        )
                        for salt in range(tree.salts[leaf]):
                            yield _batch([[v] for v in (leaf, salt, row["pack"], *data)], VISITS)

    return packs.mapInArrow(route, VISITS)


def meet(going: DataFrame, blocks: DataFrame, tree: Tree, same: bool, top: int) -> DataFrame:
    """The first ``top`` rows of each block inside each window, of the anchor's label or of all others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, q, windows = _unpacked(row, tree.width)
                slots = np.frombuffer(row["slots"], np.int32)
                held, theirs = row["block_ids"], np.frombuffer(row["block_labels"], np.int32)
                x = np.frombuffer(row["block_cells"], np.int32).reshape(-1, tree.width).astype(np.float64)
                scores = q @ x.T  # whole numbers below EXACT
                fits = (labels[:, None] == theirs) == same
                out: list[tuple] = []
                for w in range(windows.shape[1]):
                    inside = fits & (scores >= windows[:, w, :1]) & (scores <= windows[:, w, 1:])
                    left = np.where(inside, scores, -np.inf)
                    if len(x) > top + 1:  # one more than wanted, since the anchor itself may be among them
                        last = np.partition(left, len(x) - top - 1, axis=1)[:, len(x) - top - 1]
                        inside &= left >= last[:, None]
                    for i in np.flatnonzero(inside.any(axis=1)).tolist():
                        at = np.flatnonzero(inside[i]).tolist()
                        itself = {j for j in at if same and np.array_equal(x[j], q[i])}
                        named = [(-int(scores[i, j]), n) for j in at for n in held[j] if not (j in itself and n == ids[i])]
                        out += [(row["pack"], int(slots[i]), w, ids[i], -s, n) for s, n in sorted(named)[:top]]
                yield _batch(list(zip(*out, strict=True)) if out else [[]] * 6, FOUND)

    named = blocks.select("leaf", "salt", *[F.col(c).alias(f"block_{c}") for c in ("ids", "labels", "cells")])
    return going.join(named, ["leaf", "salt"]).mapInArrow(compare, FOUND)


def first_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("pack", "slot", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(packs: DataFrame, blocks: DataFrame, tree: Tree, same: bool, top: int) -> DataFrame:
    """FOUND with ``rank``: the first ``top`` rows of every window, over all blocks that it reaches."""
    near = written(first_of(meet(visits(packs, tree, True), blocks, tree, same, top), top).drop("rank"), "near")
    worst = near.groupBy("pack", "slot", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))

    def narrow(pack: pa.Table, bounds: pa.Table) -> pa.Table:
        rows = []
        for row in pack.to_pylist():
            windows = np.frombuffer(row["windows"], np.int64).reshape(len(row["ids"]), -1, 2).copy()
            at = tuple(np.asarray(bounds[c]).astype(np.int64) for c in ("slot", "window"))
            # Rows that tie with the last one may still come before it, by their ids.
            windows[(*at, 0)] = np.asarray(bounds["least"])
            rows.append((*(row[c] for c in ("pack", "ids", "labels", "cells")), windows.tobytes()))
        return _table(list(zip(*rows, strict=True)), PACKS)

    full = worst.filter(F.col("n") >= top).groupBy("pack")
    narrowed = packs.groupBy("pack").cogroup(full).applyInArrow(narrow, PACKS)
    return first_of(near.union(meet(visits(narrowed, tree, False), blocks, tree, same, top)), top)


def with_windows(packs: DataFrame, positives: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """Packs whose windows are those of the anchors' positives, in order; a missing positive gives an empty one."""

    def windows(pack: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for row in pack.to_pylist():
            out = np.tile(np.array([1, 0], np.int64), (len(row["ids"]), count, 1))
            for slot, rank, score in zip(*(found[c].to_pylist() for c in ("slot", "rank", "score")), strict=True):
                out[slot, rank - 1] = -(-low * score // 100), high * score // 100
            rows.append((*(row[c] for c in ("pack", "ids", "labels", "cells")), out.tobytes()))
        return _table(list(zip(*rows, strict=True)), PACKS)

    return written(packs.groupBy("pack").cogroup(positives.groupBy("pack")).applyInArrow(windows, PACKS), "windows")


def hard_negatives(
    table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """For each anchor (``vec_id`` divisible by ``every``) and each of its first ``positives`` other rows of its label: the
    first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's.

    Reads ``vec_id``, ``embedding``, ``label``; rows with a null in them or with a non-finite component take no part. Ids
    divisible by ``MOVED`` have label (label + 1) % ``LABELS``. A score is the product of the integers
    floor(``SCALE`` * x); higher ones come first, ties by the smaller id. Vectors of different lengths meet as if the
    shorter one ended in zeros. Rows that agree in all three count once; rows that only share an id are different rows. Components that
    do not fit exact scores raise an error. Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``; a positive without negatives has no row.
    """
    rows = written(integer_rows(table), "rows")
    # One point per different vector and label, with as many of its smallest ids as can ever be asked for.
    rank = F.row_number().over(Window.partitionBy("label", "cells").orderBy("id"))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= max(positives, negatives) + 1)
    points = few.groupBy("label", "cells").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = written(points.mapInArrow(_with_norm, "label int, cells binary, ids array<long>, norm double"), "points")
    tree = plant(points)
    blocks = pack_blocks(points, tree)
    measure(blocks, tree)
    anchors = rows.filter(F.col("id") % every == 0)
    packs = pack_anchors(anchors, anchors.count(), tree)
    first = written(search(packs, blocks, tree, True, positives), "positives")
    asked = with_windows(packs, first, positives, low, high)
    found = search(asked, blocks, tree, False, negatives)
    best = first.select(
        "pack", "slot", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return found.join(best, ["pack", "slot", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _with_norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [float((np.frombuffer(c, np.int32).astype(np.float64) ** 2).sum()) for c in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms, pa.float64())], names=[*batch.schema.names, "norm"])
