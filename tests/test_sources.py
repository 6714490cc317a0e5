import pytest
from pyspark.sql import functions as F

from pairloom.sources import lines as src


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def write(path, lines, end="\n"):
    path.write_bytes(end.join(lines).encode())
    return str(path)


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    lines = [f"{i} " + "é" * (i % 13) for i in range(400)]
    path = write(tmp_path / "a.txt", lines)
    df = src.read_lines(spark, [path])
    assert df.rdd.getNumPartitions() > 5
    got = sorted((r.line_no, r.line) for r in df.collect())
    assert got == [(i, line.strip()) for i, line in enumerate(lines)]


def test_several_files_and_csv_header(spark, tmp_path, small_splits):
    a = write(tmp_path / "a.txt", ["\ta \x1f", "", "b"])
    b = write(tmp_path / "b.csv", ["head"] + [f"row{i}" for i in range(100)], "\r\n")
    rows = sorted((r.file_no, r.line_no, r.line) for r in src.read_lines(spark, [b, a]).collect())
    assert rows[0] == (0, 0, "row0") and rows[99] == (0, 99, "row99")
    assert rows[100:] == [(1, 0, "a"), (1, 1, ""), (1, 2, "b")]


def test_range_is_not_padded(spark, tmp_path):
    path = write(tmp_path / "a.txt", [str(i) for i in range(10)])
    got = sorted(r.line for r in src.read_line_range(spark, path, 7, 1000).collect())
    assert got == ["7", "8", "9"]


def jobs_of(spark, build):
    """What ``build`` returns, and the jobs that ran meanwhile."""
    context = spark.sparkContext
    context.setJobGroup("watched", "")
    try:
        return build(), len(context.statusTracker().getJobIdsForGroup("watched"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_building_starts_no_job(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.txt", [str(i) for i in range(300)])
    df, jobs = jobs_of(spark, lambda: src.read_lines(spark, [path, path]))
    assert jobs == 0 and df.count() == 600


def parts(folder, names, each=50):
    """Part files of ``each`` lines; the lines are their numbers over all."""
    folder.mkdir(parents=True)
    for i, name in enumerate(sorted(names)):
        write(folder / name, [str(n) for n in range(i * each, (i + 1) * each)])
    return str(folder)


NAMES = ["part-0", "part-1 of é", "part-2%20", "part-3", "part-4"]


def test_range_opens_only_its_files(spark, tmp_path, small_splits):
    path, index = parts(tmp_path / "many", NAMES), str(tmp_path / "index")
    src.index_lines(spark, path, index)
    assert spark.read.parquet(index).count() > 5
    whole = src.read_line_range(spark, path, 60, 140)
    pruned = src.read_line_range(spark, path, 60, 140, index)
    assert pruned.columns == whole.columns and sorted(map(tuple, pruned.collect())) == sorted(map(tuple, whole.collect()))
    # The others are not even there.
    for name in ("part-0", "part-3", "part-4"):
        (tmp_path / "many" / name).unlink()
    again = src.read_line_range(spark, path, 60, 140, index)
    assert len(again.inputFiles()) == 2
    assert sorted((r.line_no, r.line) for r in again.collect()) == [(i, str(i)) for i in range(60, 140)]
    assert src.read_line_range(spark, path, 250, 900, index).count() == 0 == src.read_line_range(spark, path, 7, 7, index).count()
    (tmp_path / "many" / "part-1 of é").write_text("longer\n" * 100)
    with pytest.raises(ValueError, match="has changed"):
        src.read_line_range(spark, path, 60, 140, index)


def test_range_of_csv_counts_from_the_second_line(spark, tmp_path):
    path, index = write(tmp_path / "a.csv", ["head"] + [str(i) for i in range(10)]), str(tmp_path / "index")
    src.index_lines(spark, path, index)
    for options in ((), (index,)):
        got = sorted((r.line_no, r.line) for r in src.read_line_range(spark, path, 0, 3, *options).collect())
        assert got == [(0, "0"), (1, "1"), (2, "2")]


@pytest.mark.parametrize("indexed", [True, False])
def test_head_copy_opens_the_first_files(spark, tmp_path, indexed):
    path, index = parts(tmp_path / "many", NAMES), str(tmp_path / "index")
    src.index_lines(spark, path, index)
    options = (index,) if indexed else ()
    for n, opened in ((0, 0), (30, 1), (50, 1), (51, 2)):
        files = src._indexed(spark, index, 0, n)[0] if indexed else src._head_files(spark, path, n)
        assert len(files) == opened or (not indexed and n == 51 and len(files) == 3)
        src.head_copy(spark, path, str(tmp_path / f"copy{n}"), n, *options)
        got = [r.line for r in src.read_lines(spark, [str(tmp_path / f"copy{n}")]).orderBy("line_no").collect()]
        assert got == [str(i) for i in range(n)]
    src.head_copy(spark, path, str(tmp_path / "all"), 1000, *options)
    assert src.read_lines(spark, [str(tmp_path / "all")]).count() == 250


def test_head_copy_keeps_order(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.txt", [str(i) for i in range(300)])
    copy = str(tmp_path / "copy")
    src.head_copy(spark, path, copy, 120)
    got = [r.line for r in src.read_lines(spark, [copy]).orderBy("line_no").collect()]
    assert got == [str(i) for i in range(120)]


def test_pairs_roundtrip_and_repair(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "b"), (1, "c", ""), (2, "d", "e\tf"), (3, "g", None)], "i int, target string, pred string")
    path = str(tmp_path / "pairs")
    src.write_pairs(df, path, ["i"])
    got = [(r.target, r.pred) for r in src.read_pairs(spark, path).orderBy("line_no").collect()]
    assert got == [("a", "b"), ("c", "Q"), ("d", "Q"), ("g", "Q")]
    src.write_pairs(df.filter("i = 0"), path)
    assert src.read_pairs(spark, path).count() == 1


def test_lines_are_not_shuffled(spark, tmp_path):
    path = write(tmp_path / "a.txt", ["x", "y"])
    plan = src.read_lines(spark, [path])._jdf.queryExecution().executedPlan().toString()
    # The only shuffle is that of the counts of the splits.
    assert plan.count("Exchange hashpartitioning(path") == plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_null_lines(spark):
    df = src.parse_pairs(spark.createDataFrame([("",)], "line string"))
    row = df.select(F.col("target"), F.col("pred")).first()
    assert tuple(row) == ("", "Q")
