"""Agreement of two runs, gates and equality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from terralign.functions.vectors import cosine, dot, is_finite, max_abs_difference, sum_abs_difference
from terralign.operators.lineage import cut
from terralign.operators.nearest import all_pairs_top
from terralign.operators.quantiles import quantiles


def accuracy_report(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Two runs of vectors (id, v) side by side: n, mean and least cosine, largest and mean absolute error, relative L2 of the whole."""
    both = ref.join(test.select("id", F.col("v").alias("w")), "id")
    diff = F.zip_with("v", "w", lambda a, b: a - b)
    each = both.select(cosine(F.col("v"), F.col("w")).alias("c"), max_abs_difference(F.col("v"), F.col("w")).alias("m"), sum_abs_difference(F.col("v"), F.col("w")).alias("s"), F.size("v").alias("n"), dot(diff, diff).alias("e2"), dot(F.col("v"), F.col("v")).alias("r2"))
    return each.agg(F.count("*").alias("n"), F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"), F.max("m").alias("max_abs"), (F.sum("s") / F.sum("n")).alias("mean_abs"), (F.sqrt(F.sum("e2")) / F.sqrt(F.sum("r2"))).alias("relative_l2"))


def rank_agreement(ref: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Share of rows whose nearest other row in ref is among the k nearest in test. v should be normalized."""
    first = all_pairs_top(ref, ref, 1).select("id", F.col("other").alias("want"))
    near = all_pairs_top(test, test, k)
    hit = first.join(near, (first["id"] == near["id"]) & (first["want"] == near["other"]), "left").select(first["id"], near["other"].isNotNull().cast("int").alias("hit"))
    return hit.agg(F.count("*").alias("n"), F.avg("hit").alias("agreement"))


def margins(ref: DataFrame) -> DataFrame:
    """Best less second-best similarity to the other rows: mean, median, tenth percentile, least."""
    two = all_pairs_top(ref, ref, 2).groupBy("id").agg((F.max("score") - F.min("score")).alias("m"), F.count("*").alias("n")).where("n = 2")
    two = cut(two)  # all pairs are compared once, not for each pass over the margins
    return quantiles(two, [], "m", {"median": 0.5, "p10": 0.1}, {"n": F.count("*"), "mean": F.avg("m"), "least": F.min("m")}).select("n", "mean", "median", "p10", "least")


def _digest(rows: DataFrame, name: str, seed: int) -> Column:
    """64 bits of a column's value, nulls inside arrays and structs included. Equal values have equal ones (NaN is NaN, -0.0 is 0.0, as for <=>)."""
    x, kind = F.col(name), rows.schema[name].dataType
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (ArrayType, MapType, StructType)):
        return F.xxhash64(F.lit(seed), x.isNull(), F.size(x), F.transform(x, lambda v: v.isNull()), x)
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.xxhash64(F.lit(seed), F.to_json(F.struct(x), {"ignoreNullFields": "false"}))
    return F.xxhash64(F.lit(seed), x.isNull(), x)


def equality(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each column: rows on both sides, missing on either, and differing (null equals null).

    Rows meet by key with a digest of 128 bits for all columns together: 16 bytes cross
    the shuffle, however wide the columns. Only where these differ are digests of the single
    columns compared; no wide column is moved. Rows with a null in key are missing
    on the other side; of repeated keys every pair counts.
    """
    key, columns = list(key), list(columns)
    spark = a.sparkSession
    row = lambda d, side: d.select(*key, *(F.xxhash64(F.lit(s), *(_digest(d, c, s) for c in columns)).alias(f"_{side}{s}") for s in (1, 2)), F.lit(1).alias(f"_in_{side}"))
    both = row(a, "a").join(row(b, "b"), key, "full")
    pair = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    other = pair & ((F.col("_a1") != F.col("_b1")) | (F.col("_a2") != F.col("_b2")))
    met = cut(both.groupBy(other.alias("_other")).agg(F.count_if(pair).alias("_both"), F.count_if(~pair).alias("_missing")))
    found = met.collect()  # two rows
    n_both, n_missing, apart = sum(r["_both"] for r in found), sum(r["_missing"] for r in found), sum(r["_both"] for r in found if r["_other"])
    counts = dict.fromkeys(columns, 0)
    if apart:
        keys = cut(both.where(other).select(*key).distinct())
        each = lambda d, side: d.select(*key, *(F.struct(*(_digest(d, c, s) for s in (1, 2))).alias(f"_{side}_{i}") for i, c in enumerate(columns))).join(keys, key, "left_semi")
        pairs = each(a, "a").join(each(b, "b"), key)
        told = pairs.agg(*(F.count_if(F.col(f"_a_{i}") != F.col(f"_b_{i}")).alias(f"_{i}") for i in range(len(columns)))).first()
        counts = {c: told[f"_{i}"] for i, c in enumerate(columns)}
    rows = [(c, n_both, n_missing, n, n == 0 and n_missing == 0) for c, n in counts.items()]
    return spark.createDataFrame(rows, "name string, n_both long, n_missing long, n_differing long, equal boolean")


def gate(report: DataFrame, thresholds: DataFrame) -> DataFrame:
    """report (mode, min_cosine, max_abs) against thresholds (mode, least_cosine, most_abs); a null threshold only reports."""
    both = report.join(thresholds, "mode", "left")
    ok = lambda c: F.coalesce(c, F.lit(True))
    return both.withColumn("passed", ok(F.col("min_cosine") >= F.col("least_cosine")) & ok(F.col("max_abs") <= F.col("most_abs"))).withColumn("report_only", F.col("least_cosine").isNull() & F.col("most_abs").isNull())


def near_ties(differing: DataFrame, margin: DataFrame, tolerance: float) -> DataFrame:
    """Whether every differing match (id) has a margin (id, margin) below 3 tolerances: n, n_near, all_near (true of none). By scene too, where both name one."""
    keys = ["id", "scene"] if "scene" in differing.columns and "scene" in margin.columns else ["id"]
    both = differing.select(*keys).join(margin, keys, "left")
    near = F.coalesce(F.col("margin") < 3 * tolerance, F.lit(False))
    return both.agg(F.count("*").alias("n"), F.count_if(near).alias("n_near"), F.coalesce(F.bool_and(near), F.lit(True)).alias("all_near"))


def guarded_ratio(rows: DataFrame, a: str, b: str, boundary_a: str, boundary_b: str) -> DataFrame:
    """rows with ratio a / b, an error where the two were not measured between the same declared points."""
    same = F.col(boundary_a).isNotNull() & (F.col(boundary_a) == F.col(boundary_b))
    return rows.withColumn("ratio", F.when(same, F.try_divide(F.col(a), F.col(b))).otherwise(F.raise_error(F.lit("undeclared timing boundary")).cast("double")))


def rank_agreements(ref: DataFrame, test: DataFrame, ks: Sequence[int]) -> DataFrame:
    """For each k of ks, as top_k: the share of rows whose nearest other row in ref is among the k nearest in test."""
    first = all_pairs_top(ref, ref, 1).select("id", F.col("other").alias("want"))
    near = all_pairs_top(test, test, max(ks)).select("id", F.col("other").alias("want"), "rank")
    hit = first.join(near, ["id", "want"], "left")
    return hit.agg(*(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"top_{k}") for k in ks))


def full_accuracy_report(ref: DataFrame, test: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """accuracy_report() and rank_agreements() of two runs of normalized vectors in one row."""
    return accuracy_report(ref, test).crossJoin(F.broadcast(rank_agreements(ref, test, ks)))  # a row each


def pairwise_max_abs(builds: DataFrame) -> DataFrame:
    """For each two builds of builds (build, id, v), the first the smaller: rows in both, and the largest difference of a component."""
    a, b = builds.select(F.col("build").alias("a"), "id", "v"), builds.select(F.col("build").alias("b"), "id", F.col("v").alias("w"))
    both = a.join(b, "id").where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(max_abs_difference(F.col("v"), F.col("w"))).alias("max_abs"))


def unknown_names(requested: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """The distinct requested names that aren't known; a null name is unknown."""
    asked = requested.select(name).distinct()
    return asked.join(known.select(F.col(name).alias("_known")).distinct(), F.col(name) == F.col("_known"), "left_anti")


def finite_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean and exact median of the finite values of a column by group; nulls, NaN and infinities are left out."""
    ok = F.when(is_finite(F.col(value)), F.col(value))
    return quantiles(cut(rows.select(*by, ok.alias(value))), by, value, {"median": 0.5}, {"n": F.count(value), "mean": F.avg(value)})
