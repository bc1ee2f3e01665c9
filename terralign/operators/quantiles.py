"""Exact quantiles of groups of any size and number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralign.operators.lineage import cut
from terralign.operators.lookup import looked_up

#: Values of all groups together that are handed to Spark's own percentile, which keeps them in a task's memory.
DIRECT = 2_000_000
#: Ranges of a group in a round.
BUCKETS = 4096
#: Rounds after the first: within a power of two a double has 52 bits, and a round settles 12.
ROUNDS = 6


def _coarse(x: Column) -> Column:
    """A number that never falls as x grows: infinities, else sign and power of two (4,200 or so numbers in all)."""
    power = F.floor(F.log2(F.abs(x))).cast("int") + 1100
    return F.when(x == 0, 0).when(x == float("inf"), 3000).when(x == float("-inf"), -3000).when(x > 0, power).otherwise(-power)


def _fine(x: Column, low: Column, high: Column) -> Column:
    """The number of x among BUCKETS ranges from low to high (of one power of two and sign)."""
    return F.least(F.floor((x - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _between(low: Column, high: Column, share: Column) -> Column:
    return F.when(low == high, low).otherwise((1 - share) * low + share * high)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: dict[str, float], more: dict[str, Column] | None = None) -> DataFrame:
    """Quantiles (name: share, linear between ranks) of a column by group, and the aggregates of more.

    Nulls and NaN don't count. Infinities rank as the least and the greatest values;
    between one of them and a number lies the infinity, between both NaN. A group
    without values gives null; an empty table gives no groups (one row if by is
    empty). more sees all rows, NaN too.

    Up to DIRECT values of all groups go through Spark's percentile. Beyond, values
    are counted once by group and value; then by group and power of two, and
    the running counts tell in which powers the wanted ranks lie. Only these values go
    on, to be counted in finer ranges, until few are left or each range is one
    value; these are ranked. So no task gathers a group, however large, no group is
    broadcast but the few that hold most rows, and the rounds are bounded.
    """
    more = more or {}
    x = F.col(value).cast("double")
    base = rows.withColumn("_x", F.when(~F.isnan(x), x + F.lit(0.0)))  # and -0.0 is 0.0
    if base.select("_x").where("_x is not null").limit(DIRECT + 1).count() <= DIRECT:
        told = base.groupBy(*by).agg(*(c.alias(n) for n, c in more.items()), F.percentile("_x", list(at.values())).alias("_q"))
        return told.select(*by, *more, *(F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(at)))

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by] + [F.col(c).isNull() for c in by]
    group = F.xxhash64(F.lit(0), *names)
    values = cut(base.where("_x is not null").withColumn("_g", group).groupBy("_g", "_x").agg(F.count("*").alias("_n")))
    told = base.groupBy(*by).agg(F.count("_x").alias("_count"), *(c.alias(n) for n, c in more.items()))
    told = cut(told.withColumn("_g", group))
    place = F.transform(F.array(*(F.lit(q) for q in at.values())), lambda q: q * (F.col("_count") - 1))
    both = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(F.floor(p), F.ceil(p)))))
    todo = cut(told.where("_count > 0").select("_g", F.lit(0).alias("_r"), F.explode(both).alias("_rank"), F.lit(0).cast("long").alias("_below")))
    # _r names a range of a group; in the first round the group is the range.
    live = values.withColumns({"_r": F.lit(0), "_b": _coarse(F.col("_x"))})
    found = []
    for last in range(ROUNDS + 1):
        counts = live.groupBy("_g", "_r", "_b").agg(F.sum("_n").alias("_m"), F.count("*").alias("_rows"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = W.partitionBy("_g", "_r").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # at most as many rows as there are ranges
        summed = counts.withColumn("_s", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        inside = (F.col("_rank") >= F.col("_below") + F.col("_s")) & (F.col("_rank") < F.col("_below") + F.col("_s") + F.col("_m"))
        hit = todo.join(summed, ["_g", "_r"]).where(inside)
        hit = cut(hit.select("_g", "_r", "_b", "_rank", (F.col("_below") + F.col("_s")).alias("_below"), "_rows", "_lo", "_hi"))
        found.append(hit.where("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_x")))
        wanted = hit.where("_lo < _hi").groupBy("_g", "_r", "_b").agg(F.first("_rows").alias("_rows"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        left = wanted.agg(F.sum("_rows")).first()[0]
        if not left:
            break
        if last == ROUNDS:
            raise RuntimeError("quantiles: ranges did not close")
        met = looked_up(live, wanted, ["_g", "_r", "_b"], "_rows").where("_rows is not null")
        met = cut(met.select("_g", F.xxhash64("_r", "_b").alias("_r"), "_x", "_n", "_lo", "_hi"))
        todo = hit.where("_lo < _hi").select("_g", F.xxhash64("_r", "_b").alias("_r"), "_rank", "_below")
        if left <= DIRECT:  # few enough distinct values to rank one by one
            live = met.withColumn("_b", F.row_number().over(W.partitionBy("_g", "_r").orderBy("_x")))
        else:
            live = met.withColumn("_b", _fine(F.col("_x"), F.col("_lo"), F.col("_hi")))
        live = live.select("_g", "_r", "_b", "_x", "_n")
    each = reduce(DataFrame.unionAll, found)
    lists = each.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_m"))  # two ranks for each of at
    out = told.join(lists, "_g", "left")
    for name, q in at.items():
        p = F.lit(q) * (F.col("_count") - 1)
        out = out.withColumn(name, _between(F.element_at("_m", F.floor(p)), F.element_at("_m", F.ceil(p)), p - F.floor(p)))
    return out.select(*by, *more, *at)
