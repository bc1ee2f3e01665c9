"""Running values over slices against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from terralign.operators import runs, scan

ROWS = "g string, k long, x double"


def table(seed, n=700):
    """One group holds most rows; others are small, one is null; a third of the values are null."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, None if rng.random() < 0.35 else float(rng.randint(-50, 50))) for k in range(n)]
    rng.shuffle(rows)
    return rows


def by_group(rows):
    out = {}
    for g, k, x in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((k, x))
    return out


@pytest.mark.parametrize("small,slices", [(10**6, None), (0, 13), (0, 1), (100, 40)])
def test_running_values(spark, monkeypatch, small, slices):
    monkeypatch.setattr(scan, "SMALL", small)
    rows, x, k = table(1), F.col("x"), [F.col("k")]
    values = {"sum": scan.total(x, F.lit(0.0)), "most": scan.greatest(x), "last": scan.latest(x, k), "prev": scan.previous(x, k), "first": scan.first(x, k)}
    got = {(r.g, r.k): (r["sum"], r["most"], r["last"], r["prev"], r["first"]) for r in scan.scanned(spark.createDataFrame(rows, ROWS).repartition(5), ["g"], ["k"], values, slices).collect()}
    for g, own in by_group(rows).items():
        total, most, last, prev = 0.0, None, None, None
        for key, v in own:
            last = last if v is None else v
            assert got[g, key] == (total, most, last, prev, own[0][1])
            total, prev = total + (v or 0.0), v
            most = v if most is None else most if v is None else max(most, v)
    assert len(got) == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_statistics_of_runs_are_the_same_in_slices(spark, monkeypatch, seed):
    df = spark.createDataFrame(table(seed), ROWS)
    spans = df.where("x is not null").select("g", F.col("k").cast("double").alias("start"), (F.col("k") + F.abs("x") / 20).alias("stop"))
    spans = spans.unionAll(spans.where("start % 5 = 0"))  # equal intervals

    def made():
        return {
            "busy": runs.busy(spans, ["g"], F.lit(20.0), F.lit(650.0)),
            "filled": runs.filled_forward(df.withColumn("y", F.col("x").cast("string")), ["g"], "k", "y"),
            "previous": runs.previous_config(df, ["g"], "k", "x"),
            "greedy": runs.until_threshold(df.where("x > 0"), ["g"], "x", "k", 400.0),
        }

    tidy = lambda rows: sorted(str([(c, round(v, 6) if isinstance(v, float) else v) for c, v in sorted(r.asDict().items())]) for r in rows)
    whole = {n: tidy(d.collect()) for n, d in made().items()}
    monkeypatch.setattr(scan, "SMALL", 0)
    assert {n: tidy(d.collect()) for n, d in made().items()} == whole and all(whole.values())
    assert made()["busy"].where("g = 'none'").count() == 0 and runs.busy(spans.limit(0), ["g"], F.lit(0.0), F.lit(1.0)).count() == 0


def test_one_hot_group_is_spread_evenly(spark):
    """400,000 intervals of one group over 32 tasks: none has more than twice the median."""
    df = spark.range(400_000).select(F.lit("g").alias("g"), (F.col("id") * 48271 % 400_009).cast("double").alias("a"))
    dealt = scan.dealt_out(df, ["g"], ["a"], 32)
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) == 32 and sizes[-1] <= 2 * sizes[16]
    assert dealt.select("_slice", F.spark_partition_id().alias("p")).where("_slice <> p").count() == 0


def test_busy_in_slices_matches_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(scan, "SMALL", 10)
    rng = random.Random(3)
    spans = [("h", a := rng.uniform(0, 1000), a + rng.choice([0.1, 1, 30])) for _ in range(3000)] + [("h", None, 5.0), ("h", 3.0, float("nan"))]
    got = runs.busy(spark.createDataFrame(spans, "g string, start double, stop double"), ["g"], F.lit(100.0), F.lit(900.0)).first()
    cut = sorted((max(a, 100.0), min(b, 900.0)) for _, a, b in spans[:-2] if max(a, 100.0) < min(b, 900.0))
    length, islands, end = 0.0, 0, None
    for a, b in cut:
        if end is None or a > end:
            islands, length, end = islands + 1, length + b - a, b
        elif b > end:
            length, end = length + b - end, b
    assert abs(got.busy - length) < 1e-6 and got.n_islands == islands and abs(got.total - sum(b - a for a, b in cut)) < 1e-6
