"""Helpers shared by the corpus operators: cutting lineage and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralign.operators.lineage import checkpoint_folder
from terralign.operators.lineage import cut as checkpointed
from terralign.operators.lookup import looked_up

__all__ = ["checkpointed", "components", "forget", "looked_up", "noted", "ranked", "removed", "spare", "written"]


def spare(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/terralign-{spark.sparkContext.applicationId}"


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove tables of written(), once the results that read them are stored."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Remove all tables of written() of this application: for long sessions."""
    removed(spark, [_folder(spark)])


_noted: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that written() stores tables at inside the block, in order."""
    mark = _noted.set(paths := [])
    try:
        yield paths
    finally:
        _noted.reset(mark)


#: Spark's setting that removes a query's shuffle files at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept when executors are lost.

    The files of its shuffles go once it is stored, not whenever the driver next
    collects garbage; until then they serve what lost executors must redo.
    rows: at most so many rows to an Arrow batch, for Python work on wide rows.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    if (paths := _noted.get()) is not None:
        paths.append(path)
    settings = {SHUFFLES_GO: "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.option("parquet.block.size", str(32 << 20)).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


#: Edges that one task takes at least, in components().
EDGES = 250_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node.

    Alternates the large-star and small-star steps, each one aggregation and one
    equi-join on the node, until no edge changes. Few edges are handled by few tasks,
    so that the rounds don't write a file for each of many empty partitions. Nodes
    without edges are not returned; empty edges give an empty result; null ends are
    dropped.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    now = checkpointed(edges.where("a is not null and b is not null and a <> b").select(low, high).distinct())
    tasks = max(8, -(-now.count() // EDGES))
    few = (lambda df: df.coalesce(tasks)) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else (lambda df: df)
    now, mark = few(now), None
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        best = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = few(both.join(best, "u").where("v > u and v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        best = few(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = few(large.join(best, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")))
        now = checkpointed(few(small.unionAll(best.select(F.col("m").alias("lo"), "hi")).distinct()))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    star = few(now.groupBy("hi").agg(F.min("lo").alias("root"))).select(F.col("hi").alias("node"), "root")
    roots = few(star.select(F.col("root").alias("node"), "root").distinct())
    return spark.createDataFrame([], "node long, root long").unionAll(star).unionAll(roots)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, bucket: Column | None = None, buckets: int = 1024) -> DataFrame:
    """df (a written table) with name: a gapless rank from 0 within keys.

    Rows of one key are dealt into buckets, ranked inside each, and shifted by the
    sizes of the buckets before; so no key, however hot, is ranked in one task. Only
    the sizes (at most distinct keys x buckets rows) are gathered by key. bucket: a
    number that grows with order, for ranks in that order; a hash if none is given.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    return dealt.withColumn("_r", F.row_number().over(inside)).join(sizes, [*keys, "_b"]).withColumn(name, (F.col("_at") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_at")
