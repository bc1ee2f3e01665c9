"""Quantiles against numpy, by Spark's percentile and by counted ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.operators import lookup, quantiles, runs

AT = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "p100": 1.0}


def values(seed):
    """Groups of all kinds of doubles: wide, narrow, denormal, infinite, repeated, empty."""
    rng = random.Random(seed)
    groups = {
        "plain": [rng.gauss(100, 30) for _ in range(3000)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)],
        "edge": [1e308, -1e308, 1.7e308, -1.7e308, 0.0, -0.0, 5e-324, 1e-323, -5e-324],
        "denormal": [5e-324, 1e-323],
        "close": [1.0, math.nextafter(1.0, 2.0), math.nextafter(math.nextafter(1.0, 2.0), 2.0)] * 50,
        "repeated": [7.5] * 4000 + [7.25],
        "odd": [math.nan, math.inf, 1.0, 2.0, None, -math.inf, math.nan],
        "infinite": [math.inf] * 3,
        "nothing": [None, math.nan],
        None: [3.0, 1.0, 2.0],
        "one": [-4.5],
    }
    return [(g, x) for g, xs in groups.items() for x in xs]


def want(rows):
    out = {}
    for g, x in rows:
        out.setdefault(g, [])
        if x is not None and not math.isnan(x):
            out[g].append(x)
    told = {}
    for g, xs in out.items():
        xs.sort()
        told[g] = []
        for q in AT.values():
            if not xs:
                told[g].append(None)
                continue
            p = q * (len(xs) - 1)
            lo, hi, f = xs[math.floor(p)], xs[math.ceil(p)], p - math.floor(p)
            told[g].append(lo if lo == hi else (1 - f) * lo + f * hi)
    return told


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12)))


@pytest.mark.parametrize("direct", [2_000_000, 500, 0])
def test_all_kinds_of_doubles(spark, monkeypatch, direct):
    monkeypatch.setattr(quantiles, "DIRECT", direct)
    rows = values(1)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "x", AT, {"n": F.count("*")}).collect()}
    told = want(rows)
    assert set(got) == set(told)
    for g, expected in told.items():
        assert all(same(got[g][name], e) for name, e in zip(AT, expected, strict=True)), (g, got[g], expected)
        assert got[g]["n"] == sum(1 for h, _ in rows if h == g)
    assert quantiles.quantiles(df.limit(0), ["g"], "x", AT).count() == 0
    assert quantiles.quantiles(df.limit(0), [], "x", AT).collect()[0]["median"] is None


def test_many_groups_and_a_hot_one(spark, monkeypatch):
    """10^5 groups, none broadcast; one holds a third of all rows and is split."""
    monkeypatch.setattr(quantiles, "DIRECT", 1000)
    monkeypatch.setattr(lookup, "HOT", 4)
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100_000).alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    got = quantiles.quantiles(df, ["g"], "x", {"median": 0.5})
    plain = df.groupBy("g").agg(F.percentile("x", 0.5).alias("want"))
    assert got.join(plain, "g").where("abs(median - want) < 1e-9").count() == plain.count() > 66_000


def test_latency_stats_with_odd_values(spark):
    rows = [("a", x) for x in (1.0, 2.0, 3.0, math.inf, math.nan, 5e-324, 1e308, -1e308)]
    told = runs.latency_stats(spark.createDataFrame(rows, "stage string, ms double"), ["stage"]).first()
    assert told["p50"] == 2.0 and np.isinf(told["p99"])


def test_lookup_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT", 3)
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 30)] + [(None, 1), (99, 1)], "k int, v int")
    table = df.where("k is not null and k < 20").groupBy("k").agg(F.count("*").alias("n"))
    got = lookup.looked_up(df, table, ["k"], "n", least=1)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.join(table, "k", "left").collect()))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
