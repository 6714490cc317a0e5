"""Near-duplicate documents: a grouped prefix join on word shingles.

Sets are sorted by one global order, rare shingles first. Two sets with Jaccard similarity of at
least ``percent`` share a shingle among the first ``n - ceil(percent * n / 100) + 1`` of each.

1. Documents with equal sets are one class; one document stands for it.
2. Shingles in the lower part of the hash range are counted over all classes: those in one class
   only are never sent, frequent ones come last in the order.
3. Classes with the same size and the same prefix are one group with one entry per shingle.
4. Groups of several members, and groups that meet at a crowded shingle, form families. The members of a
   family are compared in blocks of similar size, inside a task each: a large group of near copies
   sends a set once per pair of blocks, and its pairs never become rows.
5. At the other shingles every group first meets the one it shares most with; links give components.
   Then all pairs of groups that share a shingle but not a component are filtered by size, position and
   common prefix, expanded into members, and verified. So no link between components is missed.

A shingle is a 64-bit hash; sets are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import shards as sh
from pairloom.llm.components import components, spanning, written
from pairloom.llm.words import LOWER, NOT_SPACE, find_words, hash_words, shingle_hashes

WORDS, PERCENT = 5, 80
FREQUENT = 16  # classes; a shingle in more of them comes last in the order
CROWD = 32  # groups; those at a shingle with more are compared block by block
BLOCK_ROWS = 256
COUNTED = 0.45  # of the hash range: a prefix is a fifth of a set, frequent shingles left out
NAME_BITS = 48
CHOSEN, COUNTS = 1, 2


def _sets(shard: sh.Shard, slots: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of some documents of a shard."""
    sizes = shard.sizes[slots]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    pieces = [shard.data[shard.starts[i] : shard.starts[i + 1]] for i in slots]
    data = LOWER[np.concatenate(pieces)] if pieces else np.zeros(0, np.uint8)
    begin, end, first = find_words(data, starts, NOT_SPACE)
    values, ptr = shingle_hashes(hash_words(data, begin, end), first, k)
    return [np.unique(values[ptr[i] : ptr[i + 1]]) for i in range(len(slots))]


def _long(x: np.uint64) -> int:
    return int(np.uint64(x).view(np.int64))


DOCS = "node long, id long, n long, low long, high long"
DOCS_ARROW = pa.schema([(c, pa.int64()) for c in ("node", "id", "n", "low", "high")])


def _documents(shard: sh.Shard, k: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for slot, s in enumerate(_sets(shard, np.arange(len(shard)), k)):
        low = sh.mix(s).sum(dtype=np.uint64)
        high = sh.mix(s ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)
        rows.append((shard.shard * sh.MAX_SLOTS + slot, shard.ids[slot], len(s), _long(low), _long(high)))
    yield sh.rows_batch(rows, DOCS_ARROW)


def _choose(classes: DataFrame) -> DataFrame:
    """The slots that stand for a class, as notes to their shards."""

    def slots(table: pa.Table) -> pa.Table:
        node = np.sort(table["node"].to_numpy())
        bits = sh.squeeze((node % sh.MAX_SLOTS).astype("<i4").tobytes())
        rows = [(int(node[0] // sh.MAX_SLOTS), CHOSEN, 0, bits)]
        return pa.Table.from_batches([sh.rows_batch(rows, sh.NOTES_ARROW)])

    nodes = classes.select(F.col("node"), F.shiftright("node", 16).alias("shard"))
    return nodes.groupBy("shard").applyInArrow(slots, sh.NOTES_SCHEMA)


def _chosen(notes: pa.Table) -> np.ndarray:
    mine = notes.filter(pc.equal(notes["kind"], CHOSEN))["bits"].to_pylist()
    return np.frombuffer(b"".join(sh.expand(x) for x in mine), "<i4").astype(np.int64)


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the shingles below the limit, and in how many of the sets they are."""
    limit = np.uint64(int(COUNTED * 2**64))
    low = [s[: np.searchsorted(s, limit)] >> np.uint64(64 - NAME_BITS) for s in sets]
    return np.unique(np.concatenate(low) if low else np.zeros(0, np.uint64), return_counts=True)


def _classify(names: np.ndarray, extras: list, owner: np.ndarray) -> np.ndarray:
    """0: in one class; 1: in several; 2: in many."""
    local = np.frombuffer(b"".join(extras), np.uint8)
    _, inverse = np.unique(names, return_inverse=True)
    total = np.bincount(inverse.reshape(-1), weights=local)[inverse.reshape(-1)]
    return (total > 1).astype(np.uint8) + (total > FREQUENT)


PREFIX = "node long, n long, prefix long, tokens array<struct<token:long,pos:int>>"
PREFIX_ARROW = pa.schema(
    [("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.int64()),
     ("tokens", pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())])))]
)


def _prefixes(shard: sh.Shard, notes: pa.Table, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    slots = _chosen(notes)
    sets = _sets(shard, slots, k)
    names, _ = _counted(sets)
    seen = sh.notes_of(notes, COUNTS)
    limit = np.uint64(int(COUNTED * 2**64))
    rows = []
    for slot, s in zip(slots, sets, strict=True):
        n = len(s)
        low = int(np.searchsorted(s, limit))
        kind = seen[np.searchsorted(names, s[:low] >> np.uint64(64 - NAME_BITS))]
        often = np.concatenate((kind == 2, np.zeros(n - low, bool)))
        worth = np.concatenate((kind > 0, np.ones(n - low, bool)))
        order = np.argsort(often, kind="stable")
        head = order[: n - -(-percent * n // 100) + 1]
        places = np.flatnonzero(worth[head])
        if len(places):
            tokens = s[head[places]].view(np.int64).tolist()
            pairs = [{"token": t, "pos": p} for t, p in zip(tokens, places.tolist(), strict=True)]
            prefix = sh.mix(s[head]).sum(dtype=np.uint64)
            rows.append((shard.shard * sh.MAX_SLOTS + int(slot), n, _long(prefix), pairs))
    yield sh.rows_batch(rows, PREFIX_ARROW)


SENT = "shard long, node long, slots array<int>, content binary"
SENT_ARROW = pa.schema(
    [("shard", pa.int64()), ("node", pa.int64()), ("slots", pa.list_(pa.int32())), ("content", pa.binary())]
)
LINKS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _verify(shards: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (hub, node) that link. A hub's set is sent once to each shard that asks for it."""
    asked = pairs.groupBy(F.shiftright("node", 16).alias("shard"), "hub").agg(
        F.collect_set((F.col("node") % sh.MAX_SLOTS).cast("int")).alias("slots")
    )
    asked = written(asked, "asked")

    def send(shard: sh.Shard, requests: pa.Table) -> Iterator[pa.RecordBatch]:
        hubs, to = requests["hub"].to_numpy(), requests["asks"].to_numpy()
        distinct, which = np.unique(hubs, return_inverse=True)
        sets = _sets(shard, distinct % sh.MAX_SLOTS, k)
        rows = []
        for i in range(len(hubs)):
            rows.append((int(to[i]), int(hubs[i]), None, sh.pack_sorted(sets[which[i]])))
            if len(rows) == 256:
                yield sh.rows_batch(rows, SENT_ARROW)
                rows = []
        yield sh.rows_batch(rows, SENT_ARROW)

    def compare(shard: sh.Shard, got: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = got.filter(pc.is_valid(got["slots"]))
        slots = asks["slots"].to_pylist()
        need = np.unique(np.concatenate([np.zeros(0, np.int64), *slots])).astype(np.int64)
        own = dict(zip(need.tolist(), _sets(shard, need, k), strict=True))
        wanted = dict(zip(asks["node"].to_pylist(), slots, strict=True))
        sent = got.filter(pc.is_valid(got["content"]))
        rows = []
        for hub, content in zip(sent["node"].to_pylist(), sent["content"].to_pylist(), strict=True):
            other = sh.unpack_sorted(content)
            for slot in wanted[hub]:
                mine = own[slot]
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                common = int((other[at] == mine).sum())
                if 100 * common >= percent * (len(mine) + len(other) - common):
                    rows.append((hub, shard.shard * sh.MAX_SLOTS + slot))
        yield sh.rows_batch(rows, LINKS_ARROW)

    requests = asked.select(F.shiftright("hub", 16).alias("shard"), "hub", F.col("shard").alias("asks"))
    sent = sh.with_notes(shards, requests, send, SENT)
    back = asked.select("shard", F.col("hub").alias("node"), "slots", F.lit(None).cast("binary").alias("content"))
    return sh.with_notes(shards, sent.union(back), compare, "u long, v long")



def _size_ok(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _enough(shared: str, a: str, b: str, percent: int) -> Column:
    """Whether two sets that share so many tokens of their prefixes can share enough in all.

    Beyond the prefix that ends first there are ``ceil(percent * n / 100) - 1`` tokens.
    """
    rest = f"greatest(ceil({percent} * {a} / 100), ceil({percent} * {b} / 100)) - 1"
    return F.expr(f"{100 + percent} * ({shared} + {rest}) >= {percent} * ({a} + {b})")


def _placed(members: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Members with ``root``, their component so far."""
    found = members.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return written(found, label)


def _open_entries(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """Entries with the components ``lo`` to ``hi`` of their group, at shingles where several components meet."""
    span = placed.groupBy(F.col("hub").alias("node")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    own = entries.join(span, "node")
    several = own.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
    return own.join(several.filter("l <> h").select("token"), "token")


def _hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """For each group the one it shares most shingles with, among the first groups of its shingles."""
    hubs = entries.groupBy("token").agg(F.min(F.struct("node", "n")).alias("h"))
    return (
        entries.join(hubs, "token")
        .filter((F.col("node") != F.col("h.node")) & _size_ok("n", "h.n", percent))
        .groupBy("node", F.col("h.node").alias("hub"))
        .count()
        .groupBy("node")
        .agg(F.max(F.struct("count", "hub")).alias("best"))
        .select("best.hub", "node")
    )


def _pairs(entries: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components that pass the filters; a shingle has at most CROWD entries."""
    open_ = _open_entries(entries, placed)
    a, b = open_.alias("a"), open_.alias("b")
    # Through a common shingle at these places at most so many can be shared.
    most = F.expr("least(a.pos, b.pos) + least(a.n - a.pos, b.n - b.pos)")
    pairs = (
        a.join(
            b,
            (F.col("a.token") == F.col("b.token"))
            & (F.col("a.node") < F.col("b.node"))
            & (F.least("a.lo", "b.lo") != F.greatest("a.hi", "b.hi"))
            & _size_ok("a.n", "b.n", percent)
            & ((100 + percent) * most >= percent * (F.col("a.n") + F.col("b.n"))),
        )
        .groupBy(F.col("a.node").alias("g"), F.col("b.node").alias("h"), F.col("a.n").alias("gn"), F.col("b.n").alias("hn"))
        .count()
        .filter(_enough("count", "gn", "hn", percent))
        .select("g", "h")
    )
    left = placed.select(F.col("hub").alias("g"), F.col("node").alias("x"), F.col("root").alias("rx"))
    right = placed.select(F.col("hub").alias("h"), F.col("node").alias("y"), F.col("root").alias("ry"))
    crossing = (
        pairs.join(left, "g")
        .join(right, "h")
        .filter("rx <> ry")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    crossing = written(crossing, "crossing")
    # The set of the one with more pairs travels: one copy serves all documents of a shard.
    ends = crossing.select(F.explode(F.array("x", "y")).alias("x")).groupBy("x").count()
    both = crossing.join(ends.withColumnRenamed("count", "cx"), "x").join(ends.toDF("y", "cy"), "y")
    return both.select(
        F.when(F.col("cx") >= F.col("cy"), F.col("x")).otherwise(F.col("y")).alias("hub"),
        F.when(F.col("cx") >= F.col("cy"), F.col("y")).otherwise(F.col("x")).alias("node"),
    )


def _families(crowded: DataFrame, members: DataFrame) -> DataFrame:
    """Members (``node``, ``n``) of groups that crowded shingles connect, and of groups of several members:
    ``family``. Documents of different families share no crowded shingle and no prefix."""
    hubs = crowded.groupBy("token").agg(F.min("node").alias("h"))
    edges = crowded.join(hubs, "token").select(F.col("node").alias("u"), F.col("h").alias("v"))
    found = components(edges)
    several = members.filter("node <> hub").select("hub").union(crowded.select("node")).distinct()
    family = several.join(found, F.col("hub") == F.col("node"), "left").select(
        "hub", F.coalesce("root", "hub").alias("family")
    )
    return members.join(family, "hub").select("node", "n", "family")


BLOCK = "family long, c int, s int, d int, t int, second boolean, node long, content binary"
BLOCK_ARROW = pa.schema(
    [("family", pa.int64()), *((x, pa.int32()) for x in "csdt"), ("second", pa.bool_()), ("node", pa.int64()), ("content", pa.binary())]
)


def _blocks(people: DataFrame, percent: int) -> DataFrame:
    """Which blocks of a family are compared: class c with its own blocks and those of the next class.

    Sizes that can link differ by less than a class. ``places`` are the pairs of blocks of a member.
    """
    width = float(np.log(100 / percent) * 1.01)
    classed = people.withColumn("c", F.floor(F.log("n") / F.lit(width)).cast("int"))
    counts = classed.groupBy("family", "c").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("m"))
    near = lambda step, name: counts.select("family", (F.col("c") + step).alias("c"), F.col("m").alias(name))
    wide = (
        classed.join(counts, ["family", "c"])
        .join(near(-1, "above"), ["family", "c"], "left")
        .join(near(1, "below"), ["family", "c"], "left")
        .withColumn("s", F.pmod(F.hash("node"), F.col("m")))
    )
    upto = lambda m: f"CASE WHEN {m} IS NULL THEN cast(array() AS array<int>) ELSE sequence(0, {m} - 1) END"
    places = f"""concat(
      transform(sequence(0, m - 1), x -> struct(c AS c, least(s, x) AS s, c AS d, greatest(s, x) AS t, s > x AS second)),
      transform({upto("above")}, x -> struct(c AS c, s AS s, c + 1 AS d, x AS t, false AS second)),
      transform({upto("below")}, x -> struct(c - 1 AS c, x AS s, c AS d, s AS t, true AS second)))"""
    return wide.select(F.shiftright("node", 16).alias("shard"), "node", "family", F.expr(places).alias("places"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over shingles that occur twice."""
    values = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    often = counts > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(often.sum()), 8192):
        lo, hi = np.searchsorted(column, [start, start + 8192])
        part = np.zeros((len(a) + len(b), 8192), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        total += part[: len(a)] @ part[len(a) :].T
    return total.astype(np.int64)


def _crowd_links(shards: DataFrame, people: DataFrame, k: int, percent: int) -> DataFrame:
    """Links inside families, block by block. A set travels once per pair of blocks; pairs never are rows."""

    def send(shard: sh.Shard, requests: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = requests["node"].to_pylist()
        sets = _sets(shard, np.asarray(nodes, np.int64) % sh.MAX_SLOTS, k)
        rows = []
        for node, family, places, s in zip(nodes, requests["family"].to_pylist(), requests["places"].to_pylist(), sets, strict=True):
            content = sh.pack_sorted(s)
            rows += [(family, p["c"], p["s"], p["d"], p["t"], p["second"], node, content) for p in places]
        yield sh.rows_batch(rows, BLOCK_ARROW)

    def compare(rows: pa.Table) -> pa.Table:
        second = np.asarray(rows["second"])
        node = np.asarray(rows["node"])
        sets = [sh.unpack_sorted(x) for x in rows["content"].to_pylist()]
        first, other = np.flatnonzero(~second), np.flatnonzero(second)
        if (rows["c"][0], rows["s"][0]) == (rows["d"][0], rows["t"][0]):
            other = first
        size = np.array([len(x) for x in sets])
        links = np.zeros((0, 2), np.int64)
        if len(first) and len(other):
            common = _common([sets[i] for i in first], [sets[i] for i in other])
            union = size[first][:, None] + size[other][None, :] - common
            x, y = np.nonzero(100 * common >= percent * union)
            links = np.stack((node[first[x]], node[other[y]]), 1)
            links = links[links[:, 0] < links[:, 1]] if other is first else links
        batch = pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=LINKS_ARROW)
        return pa.Table.from_batches(list(spanning([batch])), schema=LINKS_ARROW)

    blocks = sh.with_notes(shards, _blocks(people, percent), send, BLOCK)
    return blocks.groupBy("family", "c", "s", "d", "t").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``node``, ``id``, ``n`` (set size) and ``component`` (smallest id reachable by links).

    One row per input row of ``doc_id``, ``text``. A text without words (null, empty, white space) has
    an empty set and is linked with nothing: its component is its own id. Null ids never are the
    smallest; a component of null ids has a null component.
    """
    shards = sh.pack(docs)
    rows = written(sh.per_shard(shards, lambda s: _documents(s, k), DOCS), "sets")
    key = ["n", "low", "high"]
    classes = written(
        rows.filter("n > 0").groupBy(*key).agg(F.min("node").alias("node"), F.min("id").alias("id")), "classes"
    )
    chosen = written(_choose(classes), "chosen")
    buckets = sh.bucket_count(docs)

    def count(shard: sh.Shard, notes: pa.Table) -> Iterator[pa.RecordBatch]:
        names, counts = _counted(_sets(shard, _chosen(notes), k))
        sent = sh.send_names(shard.shard, names, np.minimum(counts, 255).astype(np.uint8), buckets, NAME_BITS)
        yield sh.rows_batch(sent, sh.NAMES_ARROW)

    counted = sh.answer(sh.with_notes(shards, chosen, count, sh.NAMES_SCHEMA), COUNTS, _classify)
    prefixes = written(
        sh.with_notes(shards, chosen.union(counted), lambda s, t: _prefixes(s, t, k, percent), PREFIX), "prefixes"
    )
    groups = prefixes.groupBy("n", "prefix").agg(F.min("node").alias("hub"))
    members = written(prefixes.select("node", "n", "prefix").join(groups, ["n", "prefix"]).drop("prefix"), "members")
    entries = written(
        prefixes.join(members.filter("node = hub").select("node"), "node", "left_semi").select(
            "node", "n", F.explode("tokens").alias("t")
        ).select("node", "n", "t.token", "t.pos"),
        "entries",
    )

    crowds = entries.groupBy("token").agg((F.count("*") > CROWD).alias("crowded"))
    entries = written(entries.join(crowds, "token"), "crowds")
    crowded, entries = entries.filter("crowded").drop("crowded"), entries.filter("NOT crowded").drop("crowded")
    people = written(_families(crowded, members), "families")
    edges = _crowd_links(shards, people, k, percent).union(_verify(shards, _hub_pairs(entries, percent), k, percent))
    edges = written(edges, "links")
    placed = _placed(members, edges, "placed")
    # Written, so that no task runs two Python workers, one on top of the other.
    more = written(_verify(shards, _pairs(entries, placed, percent), k, percent), "more")
    found = components(edges.union(more))

    roots = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = written(roots, "roots")
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    named = roots.join(least, "root").select(*key, "component")
    whole = rows.join(named, key, "left")
    return whole.select(
        "node", "id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component")
    )
