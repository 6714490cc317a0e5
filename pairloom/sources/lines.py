"""Tagged line files: scan with line numbers, scan a range, copy a head, write and repair pairs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.functions.tokens import MAX_TOKENS, Vocabulary
from pairloom.functions.util import as_col
from pairloom.session import planned_bytes, split_bytes

BROADCAST_SPLITS = 200_000  # about 30 MB


def _scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the file and split they come from; ``_row`` orders the lines of a split."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )


def _splits(scan: DataFrame) -> DataFrame:
    """One row per split of a scan: its first ``_row``, its lines (``_count``), the lines before it and its file's size.

    The window holds a row per split in one task, no more than the split list from which the driver plans every scan.
    """
    counted = scan.groupBy("path", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"), F.max("_size").alias("_size"))
    before = Window.orderBy("path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0)))


def _most_splits(scan: DataFrame) -> int:
    """An upper bound of the splits of a scan, from sizes that the driver knows without a job."""
    spark = scan.sparkSession
    return planned_bytes(scan) // split_bytes(spark) + spark.sparkContext.defaultParallelism + len(scan.inputFiles())


def _numbered(spark: SparkSession, paths: str | list[str], base: int = 0) -> DataFrame:
    """Lines of one file, or of one folder of part files in name order, with their numbers from ``base`` on.

    Spark numbers rows only within a task. A first pass counts the lines of every split; the offset of a split is then
    the number of lines before it. All of that is part of the plan: nothing runs while the frame is built. Up to
    BROADCAST_SPLITS splits their table is broadcast, and the lines themselves are not shuffled. A split that
    the first pass did not see stops the scan.
    """
    scan = _scan(spark, paths)
    splits = _splits(scan)
    if _most_splits(scan) <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    at = F.col("_row") - F.col("_first")
    # Both passes cut the files alike; if that ever failed, stop instead of misnumbering.
    checked = F.when((at >= 0) & (at < F.col("_count")), at).otherwise(
        F.raise_error(F.lit(f"the splits changed between two scans of {paths}"))
    )
    return scan.join(splits.drop("_size"), ["path", "_start"], "left").select(
        "path", (F.col("_offset") + checked + base).alias("line_no"), "value"
    )


def index_lines(spark: SparkSession, path: str, index: str) -> None:
    """Store a sparse index of the lines of ``path``: a row per split with its file, the file's size, its place,
    its first line and its number of lines. It is written once and spares every later range the files outside it."""
    rows = _splits(_scan(spark, path)).select(
        "path",
        F.col("_size").alias("size"),
        F.col("_start").alias("start"),
        F.col("_offset").alias("first_line"),
        F.col("_count").alias("lines"),
    )
    rows.write.mode("overwrite").parquet(index)


def _indexed(spark: SparkSession, index: str, first: int, end: int) -> tuple[list[str], int]:
    """The files that hold lines ``[first, end)``, in order, and the number of the first line of the first one."""
    splits = spark.read.parquet(index)
    overlaps = F.lit(first < end) & (F.col("first_line") < end) & (F.col("first_line") + F.col("lines") > first)
    hit = splits.filter(overlaps).select("path").distinct()
    files = splits.join(hit, "path").groupBy("path").agg(F.min("first_line").alias("first_line"), F.max("size").alias("size"))
    rows = sorted(files.collect(), key=lambda r: r["first_line"])  # the file list of the scan to come
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in rows:
        file = hadoop(_location(r["path"]))
        if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen() != r["size"]:
            raise ValueError(f"{r['path']} has changed since {index} was written")
    return [_location(r["path"]) for r in rows], rows[0]["first_line"] if rows else 0


def _location(uri: str) -> str:
    """Where a file lies, from the escaped form in which Spark names it."""
    return unquote(uri)


def _stripped(lines: DataFrame, path: str, file_no: int) -> DataFrame:
    if path.endswith(".csv"):
        lines = lines.withColumn("line_no", F.col("line_no") - 1).filter("line_no >= 0")
    return lines.select(F.lit(file_no).alias("file_no"), "path", "line_no", strip("value").alias("line"))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stripped lines of several files in the given order: ``file_no, path, line_no, line``.

    ``line_no`` starts at 0 per entry of ``paths``. The first line of a ``.csv`` entry is skipped. The files are passed over
    twice, first to count the lines of their splits.
    """
    frames = [_stripped(_numbered(spark, path), path, file_no) for file_no, path in enumerate(paths)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_line_range(spark: SparkSession, path: str, first: int, end: int, index: str | None = None) -> DataFrame:
    """Lines ``[first, end)`` as ``read_lines`` gives them. A range beyond the end of the file gives the lines there are.

    With an ``index`` of ``path`` only the files that hold the range are opened; a file whose size differs from the index
    raises an error. Without one all files are.
    """
    here = (F.col("line_no") >= first) & (F.col("line_no") < end)
    if index is None:
        return read_lines(spark, [path]).filter(here)
    header = int(path.endswith(".csv"))
    files, base = _indexed(spark, index, first + header, end + header)
    if not files:
        return spark.createDataFrame([], "file_no int, path string, line_no bigint, line string")
    return _stripped(_numbered(spark, files, base), path, 0).filter(here)


def write_lines(df: DataFrame, order: list[str], line: Column | str, path: str) -> None:
    """Write one expression as text; part files in name order hold the lines in ``order``.

    The expression is taken behind the shuffle: the sampling pass of the range partitioning runs
    the plan below it a second time.
    """
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(as_col(line).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def _head_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first files of ``path`` in name order that together hold ``n`` lines; files are counted in growing groups."""
    files = sorted(spark.read.text(path).inputFiles())
    taken = lines = 0
    while lines < n and taken < len(files):
        group = [_location(f) for f in files[taken : 2 * taken + 1]]
        lines += spark.read.text(group).count()
        taken += len(group)
    return [_location(f) for f in files[:taken]]


def head_copy(spark: SparkSession, src: str, dst: str, n: int, index: str | None = None) -> None:
    """Copy the first ``n`` lines to a new place, in order. Files behind them are not opened."""
    files = _indexed(spark, index, 0, n)[0] if index else _head_files(spark, src, n)
    lines = _numbered(spark, files) if files else spark.createDataFrame([], "line_no bigint, value string")
    write_lines(lines.filter(F.col("line_no") < n), ["line_no"], "value", dst)


def read_vocab(spark: SparkSession, path: str) -> Vocabulary:
    """Line number = id. Every ``##`` is removed."""
    rows = (
        read_lines(spark, [path])
        .select("line_no", F.replace("line", F.lit("##"), F.lit("")).alias("token"))
        .orderBy("line_no")
        .limit(MAX_TOKENS + 1)
        .collect()
    )
    return Vocabulary(tuple(r["token"] for r in rows))


def write_pairs(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write ``target <TAB> pred`` lines; each task commits its own file.

    A value with a tab or a line break could not be read back, so it stops the job.
    """
    line = F.concat_ws("\t", "target", "pred")
    broken = F.coalesce(F.col("target"), F.lit("")).rlike("[\t\n\r]") | F.coalesce(F.col("pred"), F.lit("")).rlike("[\n\r]")
    line = F.when(broken, F.raise_error(F.lit("a pair holds a tab or a line break"))).otherwise(line)
    if order:
        write_lines(df, order, line, path)
    else:
        df.select(line.alias("value")).write.mode("overwrite").text(path)


def parse_pairs(lines: DataFrame, sentinel: str = "Q") -> DataFrame:
    """Split a ``line`` column in ``target`` and ``pred``.

    The line is stripped first, so an empty prediction loses its tab. Whatever is not exactly two
    fields gets the sentinel as prediction.
    """
    fields = F.split(strip("line"), "\t", -1)
    return (
        lines.withColumn("_fields", fields)
        .withColumn("target", F.col("_fields")[0])
        .withColumn(
            "pred", F.when(F.size("_fields") == 2, F.get("_fields", F.lit(1))).otherwise(F.lit(sentinel))
        )
        .drop("_fields")
    )


def read_pairs(spark: SparkSession, path: str, sentinel: str = "Q") -> DataFrame:
    """Read written pairs back: ``line_no, target, pred``."""
    return parse_pairs(read_lines(spark, [path]), sentinel).select("line_no", "target", "pred")
