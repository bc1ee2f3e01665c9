"""Stand-ins on the driver's tables for rasters, clouds and run logs.

embeddings: a raster of 20 columns and 64 bands, one pixel a vector. part: a point
cloud. events: timings, telemetry and intervals. customer: map coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralign.contract import Contract
from terralign.functions.raster import pixel

BANDS, WIDTH, RADIUS = 64, 20, 5
CONTRACT = Contract(bands=BANDS, red=10, nir=40, ndvi_threshold=0.0)
POINTS_GT = (0.0, 2.5, 0.0, 8.5, 0.0, 0.075)  # p_size to 20 columns, p_retailprice / 100 to 20 rows
BALANCE_GT = (-500.0, 25.0, 1.5, 12.0, -0.5, 4.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, row, col, spectrum, id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("s").alias("scene"), F.expr(f"cast(vec_id div {WIDTH} as int)").alias("row"), F.expr(f"cast(vec_id % {WIDTH} as int)").alias("col"), F.col("embedding").cast("array<double>").alias("spectrum"), F.col("vec_id").alias("id"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"))


def located(points: DataFrame) -> DataFrame:
    row, col = pixel(POINTS_GT, F.col("x"), F.col("y"))
    return points.select("*", F.lit("s").alias("scene"), row.cast("int").alias("row"), col.cast("int").alias("col"))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, with microseconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, power, util, kind, day."""
    e = table(spark, sf_dir, "events")
    s = seconds(F.col("ts"))
    return e.select(F.col("event_id").alias("id"), s.alias("s"), F.col("value").alias("power"), F.col("user_id").cast("double").alias("util"), F.col("event_type").alias("kind"), F.floor(s / 86400).cast("bigint").alias("day"))


def phases(samples: DataFrame) -> DataFrame:
    """Of each day that has samples: load from 0 to 12 h, idle from 12 to 24 h; 100 items each."""
    days = samples.select("day").distinct()
    kinds = F.array(F.struct(F.lit("load").alias("n"), F.lit(0).alias("a")), F.struct(F.lit("idle").alias("n"), F.lit(43200).alias("a")))
    return days.withColumn("k", F.explode(kinds)).select(F.col("k.n").alias("name"), (F.col("day") * 86400 + F.col("k.a")).cast("double").alias("start"), (F.col("day") * 86400 + F.col("k.a") + 43200).cast("double").alias("stop"), F.lit(100).alias("n_items"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage (event type), rep (user mod 10), round, ms."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("stage"), (F.col("user_id") % 10).cast("int").alias("rep"), F.when(F.col("event_id") % 2 == 0, "fwd").otherwise("rev").alias("round"), F.col("value").alias("ms"), "event_id", "user_id")
