"""Text and report files of runs, and where results go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralign.functions.text import p50_line, telemetry


def register(spark: SparkSession) -> None:
    """Make the formats envi, las, numbers and sqlite known to a session, and let filters reach such sources."""
    from terralign.sources.dumps import NumbersSource
    from terralign.sources.envi import EnviSource
    from terralign.sources.las import LasSource
    from terralign.sources.trace import SqliteSource

    for source in (EnviSource, LasSource, NumbersSource, SqliteSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def telemetry_log(spark: SparkSession, path: str, utc_offset: str = "+0000") -> DataFrame:
    """Lines of telemetry with a time and memory: t, ram_mb, power_mw, tj, util_pct."""
    return spark.read.text(path).select(telemetry(F.col("value"), utc_offset).alias("p")).where("p is not null").select("p.*")


def phase_file(spark: SparkSession, path: str) -> DataFrame:
    """name start stop, separated by blanks."""
    return spark.read.csv(path, sep=" ", schema="name string, start double, stop double", ignoreLeadingWhiteSpace=True)


def wall_file(spark: SparkSession, path: str) -> DataFrame:
    """config number start stop, separated by blanks."""
    return spark.read.csv(path, sep=" ", schema="config string, i int, start double, stop double", ignoreLeadingWhiteSpace=True)


def json_reports(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """Reports of one JSON document each, with what pattern's named groups config, scene and round find in the file's name."""
    rows = spark.read.json(path, multiLine=True, schema=schema).withColumn("_file", F.input_file_name())
    for k, name in enumerate(("config", "scene", "round"), 1):
        rows = rows.withColumn(name, F.regexp_extract("_file", pattern, k))
    return rows.drop("_file")


def profiler_medians(spark: SparkSession, path: str) -> DataFrame:
    """Median of each profiler log that has one: file, p50_ms."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), p50_line(F.col("value")).alias("p50_ms"))
    return rows.where("p50_ms is not null")


def cache_scene(scene: DataFrame, path: str, run_id: str, by: Sequence[str] = ("scene",)) -> str:
    """Write a scene table under a run id of its own, so nothing is overwritten; returns its path."""
    target = f"{path}/run={run_id}"
    scene.write.mode("errorifexists").partitionBy(*by).parquet(target)
    return target


def json_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)


def markdown_table(report: DataFrame, limit: int = 200) -> str:
    """A small report as a Markdown table; more than limit rows are refused."""
    rows = report.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = [report.columns, ["-"] * len(report.columns), *([("" if x is None else str(x)) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def load_scene(spark: SparkSession, path: str) -> DataFrame:
    """A scene table that cache_scene wrote, of any run."""
    return spark.read.parquet(path)


def trace_tables(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, partitions: int = 8) -> tuple[DataFrame, DataFrame]:
    """A profiler's trace: its ended, named ranges (start, stop, text) and its device intervals (kind, start, stop).

    path: the profiler's SQLite file, or a folder of Parquet exports. With lo or hi only
    what overlaps [lo, hi] is read; of a SQLite file the bounds are SQLite's work, and each table
    is read in ranges of rowid.
    """

    def table(name: str, of: str, columns: str) -> DataFrame:
        if path.endswith((".sqlite", ".db")):
            rows = spark.read.format("sqlite").schema(columns).options(path=path, table=of, partitions=str(partitions)).load()
        else:
            rows = spark.read.parquet(f"{path}/{name}.parquet")
        rows = rows.where(F.col("end").isNotNull())
        rows = rows if lo is None else rows.where(F.col("end") > lo)
        return rows if hi is None else rows.where(F.col("start") < hi)

    ranges = table("ranges", "NVTX_EVENTS", "start long, end long, text string").where("text is not null").select("start", F.col("end").alias("stop"), "text")
    device = {"kernels": "CUPTI_ACTIVITY_KIND_KERNEL", "memcpys": "CUPTI_ACTIVITY_KIND_MEMCPY"}
    kinds = [table(k, of, "start long, end long").select(F.lit(k).alias("kind"), "start", F.col("end").alias("stop")) for k, of in device.items()]
    return ranges, kinds[0].unionByName(kinds[1])


def raw_dump(spark: SparkSession, path: str, kind: str = "<f4", row: int = 1, partition_bytes: int = 32 << 20) -> DataFrame:
    """A file of bare numbers, or a folder of them, as rows (file, i, v) of row numbers each; a file that isn't whole rows raises. Large files are cut at row borders, small ones packed together."""
    return spark.read.format("numbers").options(path=path, kind=kind, row=str(row), bytesPerPartition=str(partition_bytes)).load()
