from datetime import datetime, timedelta

import pytest

from pairloom.operators import logs
from pairloom.session import scratch_dir
from pairloom.streaming import streams

START = datetime(2024, 1, 1)


@pytest.fixture
def log(spark):
    """Worker 0 has 250 steps, worker 1 has 199, one second apart; the loss is the step."""
    rows = [(w, s, float(s + w), START + timedelta(seconds=s)) for w, n in ((0, 250), (1, 199)) for s in range(1, n + 1)]
    return spark.createDataFrame(rows, "w int, s int, l double, ts timestamp")


def test_windowed_loss(log):
    rows = {r.step: r for r in logs.windowed_loss(log, "s", "l", "w", "ts").collect()}
    assert sorted(rows) == [100, 200]
    assert rows[100].workers == 2 and rows[100].mean_loss == pytest.approx(51.0)
    assert rows[200].workers == 1 and rows[200].mean_loss == pytest.approx(150.5)
    assert rows[200].steps_per_sec == pytest.approx(1.0) and rows[100].steps_per_sec == pytest.approx(100 / 99)


def test_trailing_mean(log):
    rows = {r.w: r for r in logs.trailing_mean(log, ["w"], "s", "l", 200).collect()}
    assert (rows[0].n, rows[0].trailing_mean) == (200, 150.5)
    assert (rows[1].n, rows[1].trailing_mean) == (199, 101.0)


SCHEMA = "event_id bigint, ts timestamp, k string, v double"


@pytest.fixture
def source(spark, tmp_path):
    """Three files, read one per micro-batch; the last one holds rows that come too late."""
    parts = [
        [(i, START + timedelta(hours=i), "a" if i % 3 else "b", float(i)) for i in range(0, 30)],
        [(i, START + timedelta(hours=i), "a", float(i)) for i in range(30, 60)],
        [(100, START + timedelta(hours=1), "late", 5.0), (61, START + timedelta(hours=80), "a", 61.0)],
    ]
    path = str(tmp_path / "events")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, [r for rows in parts for r in rows]


def test_stream_window_drops_late_rows(spark, source):
    stream, rows = source
    means = streams.stream_windowed_mean(stream, "ts", "v", "1 day", "1 hour")
    got = {r.window_start.day: (r.n, r.mean_loss) for r in streams.run_available(spark, means, "w").collect()}
    # The watermark closes days 1 to 3; the late row is in none of them.
    assert got[1] == (24, 11.5) and got[2] == (24, 35.5)
    assert sum(n for n, _ in got.values()) <= 60


def test_stream_keep_first(spark, source):
    stream, rows = source
    keys = streams.run_available(spark, streams.stream_keep_first(stream, ["k"], "ts", "30 days"), "k")
    assert sorted(r.k for r in keys.collect()) == ["a", "b", "late"]


def test_stream_keep_first_with_watermark(spark, source):
    stream, rows = source
    keys = streams.stream_keep_first(stream, ["event_id"], "ts", "30 days")
    got = streams.run_available(spark, keys, "k")
    assert got.count() == got.distinct().count() == 62


def test_stream_history_equals_batch(spark, source):
    stream, rows = source
    history = streams.stream_loss_history(stream, "k", "event_id", "v", n=10, salts=4)
    latest = streams.latest_history(streams.run_latest(spark, history, ["key", "salt"], "h"), 10)
    got = {r.key: (r.n_seen, r.losses) for r in latest.collect()}
    for key in {r[2] for r in rows}:
        mine = sorted((r[0], r[3]) for r in rows if r[2] == key)
        assert got[key] == (len(mine), [v for _, v in mine[-10:]])


def many_batches(spark, path, count, rows):
    """One file per batch, an hour each; ``rows(b)`` gives (key, value) pairs."""
    for b in range(count):
        data = [(1000 * b + i, START + timedelta(hours=b), k, v) for i, (k, v) in enumerate(rows(b))]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_of_first_keys_stays_level(spark, tmp_path, one_partition):
    """Twenty new keys a batch over 50 batches: state holds those whose five hours the watermark has not passed, on disk."""
    stream = many_batches(spark, str(tmp_path / "in"), 50, lambda b: [(f"{b}-{i}", 1.0) for i in range(20)] * 2)
    keys = streams.stream_keep_first(stream, ["k"], "ts", "5 hours", salts=2)
    held = []
    with streams._state_on_disk(spark):
        query = (
            keys.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
            .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    for progress in query.recentProgress:
        held.append([op["numRowsTotal"] for op in progress["stateOperators"]])
        assert "rocksdb" in str(progress["stateOperators"][0]["customMetrics"]).lower()
    assert len(held) >= 50 and max(map(max, held)) <= 20 * 12 and held[15] == held[25] == held[45]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_history_table_grows_with_keys_only(spark, tmp_path, one_partition):
    """Every batch changes one of three keys; the table always has one row per key and salt, and two versions at most."""
    source, root = str(tmp_path / "in"), str(tmp_path / "table")

    def history(stream):
        return streams.stream_loss_history(stream, "k", "event_id", "v", n=4, salts=2)

    first = many_batches(spark, source, 12, lambda b: [("abc"[b % 3], float(b)), ("abc"[b % 3], b + 0.5)])
    rows = streams.run_latest(spark, history(first), ["key", "salt"], "h", root)
    assert rows.count() == rows.select("key", "salt").distinct().count() <= 6
    assert len(list((tmp_path / "table").glob("table-*"))) <= 2
    latest = {r.key: (r.n_seen, r.losses) for r in streams.latest_history(rows, 4).collect()}
    assert latest == {k: (8, [b + x for b in (6 + i, 9 + i) for x in (0.0, 0.5)]) for i, k in enumerate("abc")}
    # A later run goes on from the table and the state.
    more = many_batches(spark, source, 1, lambda b: [("a", 99.0)])
    spark.createDataFrame([(90_000, START, "a", 99.0)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    again = streams.run_latest(spark, history(more), ["key", "salt"], "h", root)
    got = {r.key: (r.n_seen, r.losses[-1]) for r in streams.latest_history(again, 4).collect()}
    assert got["a"] == (10, 99.0) and got["b"] == (8, 10.5) and got["c"] == (8, 11.5)
    assert again.count() <= 6


def test_scratch_is_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a.startswith(root) and a != b


def test_stream_queries_read_a_folder_table(spark, tmp_path):
    from pairloom.plans import logs as plans

    rows = [(i, START + timedelta(hours=i), i % 7, "ab"[i % 2], float(i)) for i in range(100)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    assert plans.stream_dedup_keys(spark, str(tmp_path)).count() == 7
    assert plans.stream_window(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("n", [1000, 1001])
def test_trailing_mean_keeps_null_keys(spark, n):
    df = spark.range(4000).selectExpr("IF(id % 2 = 0, 'a', NULL) AS k", "IF(id % 5 = 0, NULL, id) AS o", "1.0D AS v")
    rows = {r.k: r.n for r in logs.trailing_mean(df, ["k"], "o", "v", n).collect()}
    assert rows == {"a": n, None: n}
