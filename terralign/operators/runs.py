"""Timings, telemetry and intervals of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralign.functions.vectors import is_finite
from terralign.operators import scan
from terralign.operators.quantiles import quantiles


def latency_stats(timings: DataFrame, by: Sequence[str], ms: str = "ms", batch: int = 1) -> DataFrame:
    """Mean, exact p50, p95 and p99 (linear between ranks), and items a second, by group."""
    told = quantiles(timings, by, ms, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, {"n": F.count(ms), "mean": F.avg(ms)})
    return told.withColumn("per_second", F.when(F.col("mean") > 0, batch * 1000 / F.col("mean")))


def stage_medians(timings: DataFrame, by: Sequence[str], stage: str = "stage", ms: str = "ms") -> DataFrame:
    return quantiles(timings, [*by, stage], ms, {"median": 0.5}, {"least": F.min(ms)}).select(*by, stage, "median", "least")


def sum_of_medians(timings: DataFrame, by: Sequence[str], io_stages: Sequence[str], stage: str = "stage", ms: str = "ms") -> DataFrame:
    """Sum of the stages' medians, with and without the stages that read or write. Not the median of the runs' sums."""
    told = stage_medians(timings, by, stage, ms)
    return told.groupBy(*by).agg(F.sum("median").alias("with_io"), F.sum(F.when(~F.col(stage).isin(*io_stages), F.col("median"))).alias("without_io"))


def median_of_sums(timings: DataFrame, by: Sequence[str], run: str = "rep", ms: str = "ms") -> DataFrame:
    totals = timings.groupBy(*by, run).agg(F.sum(ms).alias("_t"))
    return quantiles(totals, by, "_t", {"median": 0.5}, {"n_runs": F.count("*")}).select(*by, "median", "n_runs")


def sampled_in(samples: DataFrame, phases: DataFrame, before: float, after: float, slot: float = 3600.0, closed: bool = True) -> DataFrame:
    """Samples (s seconds, ...) joined to the phases (name, start, stop seconds) with start + before <= s <= stop - after.

    Negative margins widen the phase; if it isn't closed, its end is not in it. A phase is sent to every slot of time that it
    touches and a sample to one, so this is an equi-join and not a comparison of all.
    """
    bounds = phases.withColumn("_lo", F.col("start") + before).withColumn("_hi", F.col("stop") - after).where("_lo <= _hi")
    spread = bounds.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_lo") / slot), F.floor(F.col("_hi") / slot))))
    return samples.withColumn("_slot", F.floor(F.col("s") / slot)).join(spread, "_slot").where("s >= _lo and s <= _hi" if closed else "s >= _lo and s < _hi").drop("_slot", "_lo", "_hi")


def energy(samples: DataFrame, phases: DataFrame, idle: str = "idle", trim: float = 1.0) -> DataFrame:
    """Power of each phase (name, start, stop, n_items): mean, most, mean use, joules an item in all and above idle, items a second and watt.

    Samples within trim seconds of either end don't count. Idle power is the mean of
    the idle phases' means. A phase without samples raises.
    """
    met = sampled_in(samples, phases, trim, trim)
    told = met.groupBy("name", "start").agg(F.avg("power").alias("p"), F.max("power").alias("top"), F.avg("util").alias("u"), F.count("*").alias("n"))
    every = phases.join(told, ["name", "start"], "left").withColumn("p", F.when(F.col("n") > 0, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("no samples in phase "), F.col("name"))).cast("double")))
    base = every.where(F.col("name") == idle).agg(F.avg("p").alias("_idle"))
    seconds = F.col("stop") - F.col("start")
    each = every.where(F.col("name") != idle).crossJoin(F.broadcast(base))  # one row
    return each.select("name", "start", F.col("n").alias("n_samples"), F.col("p").alias("mean_power"), F.col("top").alias("max_power"), F.col("u").alias("mean_util"), (F.col("p") * seconds / F.col("n_items")).alias("joules"), ((F.col("p") - F.col("_idle")) * seconds / F.col("n_items")).alias("joules_above_idle"), (F.col("n_items") / seconds / F.col("p")).alias("per_second_watt"))


def busy(intervals: DataFrame, by: Sequence[str], lo: Column, hi: Column) -> DataFrame:
    """Length of the union of intervals (start, stop) cut to [lo, hi], their sum, the islands, and how many lie wholly inside, by group.

    Gaps and islands, as a scan over slices of any group: sorted by start, an interval
    opens an island where it starts after everything before it has stopped, and adds
    to the union what it reaches beyond that. Equal intervals are counted first. Intervals with
    a null or NaN end, or of no length within [lo, hi], don't count.
    """
    whole = (F.col("start") >= lo) & (F.col("stop") <= hi)
    clipped = intervals.where(~F.isnan("start") & ~F.isnan("stop")).select(*by, whole.cast("int").alias("_whole"), F.greatest("start", lo).alias("_a"), F.least("stop", hi).alias("_b")).where("_a < _b")
    each = clipped.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"), F.sum("_whole").alias("_whole"))
    told = scan.scanned(each, by, ["_a", "_b"], {"_before": scan.greatest(F.col("_b"))})
    new = F.col("_before").isNull() | (F.col("_a") > F.col("_before"))
    length = F.when(new, F.col("_b") - F.col("_a")).otherwise(F.greatest(F.col("_b") - F.col("_before"), F.lit(0.0)))
    return told.groupBy(*by).agg(F.sum(length).alias("busy"), F.sum((F.col("_b") - F.col("_a")) * F.col("_n")).alias("total"), F.sum(new.cast("long")).alias("n_islands"), F.sum("_whole").cast("long").alias("n_whole"))


def previous_config(totals: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Each configuration against the one before and the first: diff, speedup (null where value is 0). order tells the rows of a group apart."""
    at = [F.col(order)]
    told = scan.scanned(totals, by, [order], {"previous": scan.previous(F.col(value), at), "_first": scan.first(F.col(value), at)})
    return told.withColumn("diff", F.col(value) - F.col("previous")).withColumn("speedup", F.try_divide("_first", value)).drop("_first")


def near_optimal(rows: DataFrame, by: Sequence[str], cost: str, memory: str, within: float = 0.05) -> DataFrame:
    """Of the rows within a share of the least cost of their group, the one of least memory (then cost)."""
    best = rows.groupBy(*by).agg(F.min(cost).alias("_best"))
    close = rows.join(best, list(by)).where(F.col(cost) <= F.col("_best") * (1 + within)).drop("_best")
    names = [c for c in rows.columns if c not in (*by, memory, cost)]
    return close.groupBy(*by).agg(F.min(F.struct(memory, cost, *names)).alias("_m")).select(*by, *(F.col("_m")[c].alias(c) for c in (cost, memory, *names)))


def filled_forward(rows: DataFrame, by: Sequence[str], order: str, group: str) -> DataFrame:
    """group of each row, or of the last row before that has one. order tells the rows of by apart."""
    told = scan.scanned(rows, by, [order], {"_filled": scan.latest(F.col(group), [F.col(order)])})
    return told.withColumn(group, F.col("_filled")).select(*rows.columns)


def until_threshold(rows: DataFrame, by: Sequence[str], gain: str, key: str, threshold: float) -> DataFrame:
    """Rows by gain, largest first, until their sum reaches threshold: what a greedy choice takes. Equal gains in order of key."""
    values = {"rank": scan.total(F.lit(1).cast("long"), F.lit(0).cast("long")), "before": scan.total(F.col(gain), F.lit(0.0))}
    told = scan.scanned(rows, by, [F.desc(gain), F.asc(key)], values)
    return told.withColumn("rank", (F.col("rank") + 1).cast("int")).where(F.col("before") < threshold)


def pairwise(rows: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Spread of repeated builds by group: std, range and the largest difference between two."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"), F.bool_and(F.col(value).isNotNull()).alias("all_there"))


def overhead(wall: DataFrame, device: DataFrame, by: Sequence[str], least_share: float = 0.1) -> DataFrame:
    """Median wall time less median device time by group, its share, and whether that share is worth work."""
    a, b = quantiles(wall, by, "ms", {"wall": 0.5}), quantiles(device, by, "ms", {"device": 0.5})
    both = a.join(b, list(by)).withColumn("overhead", F.col("wall") - F.col("device"))
    share = F.when(F.col("wall") > 0, F.col("overhead") / F.col("wall"))
    return both.withColumn("share", share).withColumn("recommended", F.coalesce(share > least_share, F.lit(False)))


def rounds_agree(rounds: DataFrame, by: Sequence[str], value: str, most: float) -> DataFrame:
    """Forward and reverse rounds (column round: fwd, rev) side by side: mean, relative difference, and whether it is below most."""
    wide = rounds.groupBy(*by).agg(F.avg(F.when(F.col("round") == "fwd", F.col(value))).alias("fwd"), F.avg(F.when(F.col("round") == "rev", F.col(value))).alias("rev"))
    rel = F.when(F.col("fwd") != 0, F.abs(F.col("fwd") - F.col("rev")) / F.abs(F.col("fwd")))
    return wide.withColumn("mean", (F.col("fwd") + F.col("rev")) / 2).withColumn("relative", rel).withColumn("agrees", F.coalesce(rel < most, F.lit(False)))


def unified_layout(rows: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Results kept as lists by ordinal (key, vals) turned into rows by variant name (key, variant, value)."""
    names = rows.sparkSession.createDataFrame(list(enumerate(variants)), "pos int, variant string")
    return rows.select("key", F.posexplode("vals").alias("pos", "value")).join(F.broadcast(names), "pos").select("key", "variant", "value")


def idle_power(samples: DataFrame, starts: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Mean power and number of samples in [start, start + seconds) of each of starts (name, start); starts without samples are left out.

    No sample meets a start. Time is cut into slots of half a window, so a window is the end of its first
    slot, from start on, and the beginning of up to three slots after, below its stop. Both are running sums
    over samples and starts in order, from the slot's end and from its beginning; nothing is subtracted.
    Times that are null, NaN or infinite are in no window.
    """
    whole = lambda d, c: d.where(F.col(c).isNotNull() & is_finite(F.col(c)))
    slot = lambda c: F.floor(c / (seconds / 2 if seconds > 0 else 1.0)).cast("long")
    at, stop = F.col("start"), F.col("start") + F.lit(float(seconds))
    asked = whole(starts.select("name", F.col("start").cast("double").alias("start")), "start").groupBy("name", "start").agg(F.count("*").alias("_times"))
    if seconds <= 0:
        asked = asked.where("false")
    power = F.col("power").cast("double")
    seen = whole(samples.select(F.col("s").cast("double").alias("s"), power.alias("power")), "s").groupBy("s").agg(F.count("*").alias("_n"), F.count("power").alias("_c"), F.coalesce(F.sum("power"), F.lit(0.0)).alias("_p"))
    # _back: from the slot's end. There a start comes after the samples of its time, else before those of its stop
    event = lambda back, slot, place, start, last: F.struct(F.lit(back).alias("_back"), slot.alias("_slot"), ((-place if back else place) + F.lit(0.0)).alias("_place"), F.lit(last).alias("_last"), start.alias("start"))
    of_sample = F.array(*(event(back, slot(F.col("s")), F.col("s"), F.lit(None).cast("double"), not back) for back in (False, True)))
    of_start = F.concat(F.array(event(True, slot(at), at, at, True)), F.transform(F.sequence(slot(at) + 1, F.greatest(slot(stop), slot(at) + 1)), lambda k: event(False, k, stop, at, False)))
    none = [F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_c"), F.lit(0.0).alias("_p")]
    events = seen.select(F.inline(of_sample), "_n", "_c", "_p").unionByName(asked.select("start").distinct().select(F.inline(of_start), *none))
    sums = {c: scan.total(F.col(c), F.lit(0.0) if c == "_p" else F.lit(0).cast("long")) for c in ("_n", "_c", "_p")}
    told = scan.scanned(events, ["_back", "_slot"], ["_place", "_last"], sums).where("start is not null")
    told = told.groupBy("start").agg(*(F.sum(c).alias(c) for c in sums)).where("_n > 0")
    return asked.join(told, "start").select("name", "start", (F.col("_n") * F.col("_times")).alias("n"), F.when(F.col("_c") > 0, F.col("_p") / F.col("_c")).alias("mean_power"))


def all_rounds_agree(rounds: DataFrame, by: Sequence[str], within: Sequence[str], value: str, most: float) -> DataFrame:
    """rounds_agree() of every (by, within), summed up by group: how many, how many agree, and whether all do."""
    each = rounds_agree(rounds, [*by, *within], value, most)
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("agrees").alias("n_agree"), F.bool_and("agrees").alias("all_agree"))


def ratio_to_config(rounds: DataFrame, by: Sequence[str], config: str, base: str, value: str) -> DataFrame:
    """Each configuration's mean over the rounds' means (column round), and base's divided by it, by group."""
    per_round = rounds.groupBy(*by, config, "round").agg(F.avg(value).alias("_v"))
    means = per_round.groupBy(*by, config).agg(F.avg("_v").alias("mean"))
    ref = means.where(F.col(config) == base).select(*by, F.col("mean").alias("_base"))
    joined = means.join(ref, list(by), "left") if by else means.crossJoin(F.broadcast(ref))  # one row
    return joined.withColumn("ratio", F.try_divide("_base", "mean")).drop("_base")


def overhead_against(wall: DataFrame, benchmark: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wall time an item (by, ms, n_items: median of ms / n_items, in microseconds) against the benchmark's row (by, us): overhead and ratio; null without a row."""
    each = wall.withColumn("_us", 1000 * F.col("ms") / F.col("n_items"))
    told = quantiles(each, by, "_us", {"wall_us": 0.5})
    return told.join(benchmark, list(by), "left").withColumn("overhead_us", F.col("wall_us") - F.col("us")).withColumn("ratio", F.try_divide("wall_us", "us"))


def cold_start(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Median, least, most and number of start-up times by group, and all of them in order (a few a configuration)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return quantiles(rows, by, value, {"median": 0.5}, {"least": F.min(value), "most": F.max(value), "n": F.count("*"), "all": listed})


def peak(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Largest value (most) and number of values (n) by group; nulls don't count."""
    return samples.groupBy(*by).agg(F.max(value).alias("most"), F.count(value).alias("n"))


def histogram(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many rows (n) each combination of values has."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def same_counts(rows: DataFrame, by: Sequence[str], run: str, least: int = 0) -> DataFrame:
    """Whether the runs of a group have as many rows: n_counts different numbers, same (one only), all_busy (each above least)."""
    n = rows.groupBy(*by, run).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.countDistinct("_n").alias("n_counts"), F.bool_and(F.col("_n") > least).alias("all_busy"), (F.countDistinct("_n") == 1).alias("same"))
