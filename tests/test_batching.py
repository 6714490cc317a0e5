import hashlib

import pytest
from pyspark.sql import functions as F

from pairloom.operators import batching as bat
from pairloom.operators import stretches


def u(seed, *keys):
    digest = hashlib.md5(":".join(map(str, [seed, *keys])).encode()).hexdigest()
    return int(digest[:13], 16) / 2**52


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_positions_are_the_sorted_order(spark, buckets):
    df = spark.range(500)
    got = {r.id: r.pos for r in bat.shuffle_positions(df, ["id"], 9, buckets=buckets).collect()}
    want = {i: p for p, i in enumerate(sorted(range(500), key=lambda i: (u(9, i), i)))}
    assert got == want


def test_shuffle_head(spark):
    got = [r.id for r in bat.shuffle_head(spark.range(100), "id", 4, 7).collect()]
    assert got == sorted(range(100), key=lambda i: u(4, i))[:7]
    assert bat.shuffle_head(spark.range(100), "id", 4).count() == 100


@pytest.mark.parametrize("n,world", [(10, 4), (12, 4), (3, 8), (1, 5), (7, 1)])
def test_shards_are_equal_and_wrap_around(spark, n, world):
    rows = bat.assign_shards(spark.range(n), ["id"], world, 1).collect()
    size = -(-n // world)
    order = {r.pos: r.id for r in rows}
    assert sorted(order) == list(range(size * world)) and len(rows) == size * world
    assert all(order[p] == order[p % n] for p in order)
    assert all(r.shard == r.pos % world and r.slot == r.pos // world and r.shard_size == size for r in rows)


def test_epoch_changes_the_order(spark):
    a = bat.shuffle_positions(spark.range(50), ["id"], 1, epoch=0).collect()
    b = bat.shuffle_positions(spark.range(50), ["id"], 1, epoch=1).collect()
    assert sorted(a) != sorted(b)


@pytest.mark.parametrize("n,size,full", [(10, 4, 2), (8, 4, 2), (3, 4, 0)])
def test_batches(spark, n, size, full):
    sharded = bat.assign_shards(spark.range(n), ["id"], 1, 1)
    kept = bat.assign_batches(sharded, size, drop_last=True).groupBy("batch_no").count().collect()
    assert {r.batch_no: r["count"] for r in kept} == {b: size for b in range(full)}
    assert bat.assign_batches(sharded, size, drop_last=False).count() == n


@pytest.mark.parametrize("n,exact,copies", [(10, False, 2), (8, False, 4), (8, True, 0), (1, False, 1)])
def test_pad_tail(spark, n, exact, copies):
    rows = bat.pad_tail(spark.range(n), "id", 4, exact).collect()
    assert sorted(r.id for r in rows if r["copy"] == 1) == list(range(copies))
    assert sum(r["copy"] == 0 for r in rows) == n


def test_pad_tail_reads_the_payload_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id % 3 AS g", "repeat('x', 9) AS payload").write.parquet(path)
    df = bat.pad_tail(spark.read.parquet(path), "g", 4, ties=["id"])
    assert sorted((r.g, r.id) for r in df.collect() if r["copy"] == 1) == [(0, 0), (0, 3)]
    plan = bat.pad_tail(spark.read.parquet(path), "g", 4, ties=["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("payload:string") == 1, plan
    with pytest.raises(Exception, match="can not be told apart"):
        bat.pad_tail(spark.read.parquet(path), "g", 4).collect()
    nulls = spark.createDataFrame([(None, "a"), (5, "b"), (4, "c")], "o int, p string")
    assert [r.p for r in bat.pad_tail(nulls, "o", 2).collect() if r["copy"] == 1] == ["a"]


def test_union_sources_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, i int")
    assert sorted(map(tuple, bat.union_sources(a, b).collect())) == [(1, "x", 0), (2, "y", 1)]


def test_zip_pairs(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, t string")
    b = spark.createDataFrame([(1, "y"), (0, "x")], "pos int, p string")
    assert sorted(map(tuple, bat.zip_pairs(a, b, "pos").collect())) == [(0, "a", "x"), (1, "b", "y")]
    with pytest.raises(Exception, match="differ in length"):
        bat.zip_pairs(a, b.filter("pos = 0"), "pos").collect()


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    got = sorted((str(r.k), r.v) for r in bat.keep_first(df, ["k"], "o").collect())
    assert got == [("None", "m"), ("a", "y"), ("b", "z")]


def test_keep_first_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = bat.keep_first(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


ORDERS = {
    "dense": "id",
    "microseconds": "1700000000000000 + id * 1000003",  # no two rows in one step of any fixed width
    "few values": "id % 3",
    "one value": "7",
    "null or not": "IF(id % 3 = 0, NULL, id % 50)",
    "all null": "CAST(NULL AS BIGINT)",
}


@pytest.fixture
def dense_sample(monkeypatch):
    monkeypatch.setattr(stretches, "SAMPLED", 1)
    monkeypatch.setattr(stretches, "SAMPLE", 512)


@pytest.mark.parametrize("kind", list(ORDERS))
def test_positions_and_stretches_of_a_hot_key(spark, dense_sample, kind):
    key = "CASE WHEN id % 10 = 0 THEN 'cold' || id % 70 WHEN id % 10 < 5 THEN NULL ELSE 'hot' END AS k"
    df = spark.range(6000).selectExpr("id", key, f"{ORDERS[kind]} AS o", "map('a', id) AS m").repartition(5)
    rows = bat.grouped_positions(df, ["k"], "o", ["id"], depth=100).collect()
    assert len(rows) == 6000
    for k in {r.k for r in rows}:
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        orders = [(r.o is None, r.o) for r in mine]
        assert orders == sorted(orders, key=lambda o: (o[0], o[1] or 0))
    sizes = stretches.cut_stretches(df, ["k"], "o", ["id"], depth=100).groupBy("k", "_stretch").count().collect()
    for k in (None, "hot"):
        mine = [r["count"] for r in sizes if r.k == k]
        assert len(mine) >= 8 and max(mine) < 2.5 * sum(mine) / len(mine), mine  # many tasks of about one size
    assert all(r["_stretch"] is None for r in sizes if r.k not in (None, "hot"))


def test_bounds_are_found_in_two_steps(spark):
    for n in (1, 2, 31, 32, 33, 64, 100, 1023):
        bounds = sorted((i * 7919) % 50 if n > 60 else i for i in range(n))
        df = spark.range(-1, 110).select("id", F.array(*map(F.lit, bounds)).alias("b"))
        for r in df.select("id", stretches._find(F.col("b"), F.col("id")).alias("f")).collect():
            assert (r.f.below, r.f.same) == (sum(b < r.id for b in bounds), bounds.count(r.id))


@pytest.mark.parametrize("n", [1, 10, 1500])
def test_last_rows(spark, n):
    df = spark.range(4000).withColumn("k", F.when(F.col("id") % 10 == 0, "cold").otherwise("hot"))
    rows = bat.last_rows(df, ["k"], "id", n).collect()
    for key in ("hot", "cold"):
        mine = [i for i in range(4000) if (i % 10 == 0) == (key == "cold")]
        assert sorted(r.id for r in rows if r.k == key) == mine[-n:]


def test_positions_of_null_keys_and_null_orders(spark):
    rows = [("a", 5), ("a", None), ("a", 2), (None, 7), (None, 1), (None, None)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    got = {(r.k, r.o): r.pos for r in bat.grouped_positions(df, ["k"], "o", depth=1).collect()}
    assert got == {("a", 2): 0, ("a", 5): 1, ("a", None): 2, (None, 1): 0, (None, 7): 1, (None, None): 2}


def test_keep_first_prefers_known_orders(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 9, 2), ("b", None, 3)], "k string, o bigint, v int")
    assert sorted(r.v for r in bat.keep_first(df, ["k"], "o").collect()) == [2, 3]
