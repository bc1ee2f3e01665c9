"""Running values along an order, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralign.operators.lineage import cut


#: Rows of a group that one task scans, at most.
SMALL = 1_000_000


@dataclass(frozen=True)
class Running:
    """A value that runs along the rows of a group.

    here: from the window of a slice's rows (in order, up to where the value looks) to the value among them.
    whole: what a slice as a whole adds, an aggregate of its rows.
    over: from the column of whole and the window of the slices before to what these add together.
    both: from what earlier slices add (null if there are none, or nothing) and the value here to the running value.
    """

    here: Callable[[object], Column]
    whole: Column
    over: Callable[[Column, object], Column]
    both: Callable[[Column, Column], Column]


def total(x: Column, zero: Column) -> Running:
    """The sum of x over the rows before; zero at the first."""
    return Running(lambda w: F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.sum(x), lambda c, w: F.sum(c).over(w), lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def greatest(x: Column) -> Running:
    """The greatest x of the rows before; null at the first."""
    return Running(lambda w: F.max(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.max(x), lambda c, w: F.max(c).over(w), F.greatest)


def latest(x: Column, order: Sequence[Column]) -> Running:
    """The last x that isn't null, of the row itself and those before. order: ascending columns that tell rows apart."""
    whole = F.max(F.when(x.isNotNull(), F.struct(*order, x.alias("x"))))["x"]
    return Running(lambda w: F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), whole, lambda c, w: F.last(c, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a))


def previous(x: Column, order: Sequence[Column]) -> Running:
    """x of the row before, which may be null; null at the first."""
    whole = F.max(F.struct(*order, x.alias("x")))["x"]
    return Running(lambda w: F.struct(F.row_number().over(w).alias("n"), F.lag(x).over(w).alias("x")), whole, lambda c, w: F.last(c).over(w), lambda a, b: F.when(b["n"] == 1, a).otherwise(b["x"]))


def first(x: Column, order: Sequence[Column]) -> Running:
    """x of the group's first row."""
    whole = F.min(F.struct(*order, x.alias("x")))["x"]
    return Running(lambda w: F.struct(F.first(x).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("x")), whole, lambda c, w: F.struct(F.first(c).over(w).alias("x")), lambda a, b: F.coalesce(a, b)["x"])


def whole_types(rows: DataFrame, values: dict[str, Running]) -> dict:
    """The type of what earlier slices add, for each value."""
    along = W.orderBy(F.lit(1))
    told = rows.agg(*(x.whole.alias(v) for v, x in values.items())).select(*(x.over(F.col(v), along).alias(v) for v, x in values.items()))
    return {f.name: f.dataType for f in told.schema}  # of the plan; nothing runs


def dealt_out(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], slices: int) -> DataFrame:
    """rows, stored, with _slice, the number of their range of (by, order), and a task for each slice."""
    told = cut(rows.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()))
    return told.repartitionById(slices, F.col("_slice"))


def scanned(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, Running], slices: int | None = None) -> DataFrame:
    """rows with running values (by name) along order within each group of by; nulls of by are a group.

    Groups are counted. If none has more than SMALL rows, each is scanned by one task. Else
    rows are dealt to slices by ranges of (by, order), so that a large group is spread over
    many tasks, and each slice is scanned by itself. A slice as a whole is then one
    row for each of its groups; along these rows, at most as many for a group as there are
    slices, runs what earlier slices add. Only a slice's first group can have begun
    before it, so what is carried over is at most one row a slice: it is broadcast.

    Rows equal in by and order lie in one slice: make order tell rows apart, or
    count equal rows beforehand.
    """
    names = list(values)
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if (rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) <= SMALL:
        inside = W.partitionBy(*by).orderBy(*order)
        here = rows.select("*", *(values[v].here(inside).alias(f"_here_{v}") for v in names))
        none = whole_types(rows, values)
        return here.select(*(c for c in rows.columns if c not in names), *(values[v].both(F.lit(None).cast(none[v]), F.col(f"_here_{v}")).alias(v) for v in names))
    dealt = dealt_out(rows, by, order, n)
    inside = W.partitionBy(*by, "_slice").orderBy(*order)
    whole = dealt.groupBy(*by, "_slice").agg(*(values[v].whole.alias(v) for v in names))
    along = W.partitionBy(*by).orderBy("_slice")
    before = along.rowsBetween(W.unboundedPreceding, -1)  # of at most n rows
    carried = whole.select(*by, "_slice", F.row_number().over(along).alias("_n"), *(values[v].over(F.col(v), before).alias(f"_{v}") for v in names)).where("_n > 1")
    carried = F.broadcast(carried.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_slice").alias("_of"), *(f"_{v}" for v in names)))
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    here = dealt.select("*", *(values[v].here(inside).alias(f"_here_{v}") for v in names)).join(carried, same, "left")
    return here.select(*(c for c in rows.columns if c not in names), *(values[v].both(F.col(f"_{v}"), F.col(f"_here_{v}")).alias(v) for v in names))
