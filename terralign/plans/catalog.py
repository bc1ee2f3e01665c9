"""Registered queries of the core library and their DuckDB counterparts, written apart from each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralign.functions import projection
from terralign.functions import raster as R
from terralign.functions import text as T
from terralign.functions import vectors as V
from terralign.operators import encode, grid, match, nearest, runs, validate
from terralign.plans import tables as D
from terralign.plans.oracles import ORACLES  # noqa: F401

QUERIES: dict = {}
CUT = 6


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(c, digits: int = CUT):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


# Scalars


@query
def ndvi_mask(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    return px.select("id", r(R.ndvi(F.col("spectrum"), D.CONTRACT.red, D.CONTRACT.nir)).alias("ndvi"), r(V.total(F.col("spectrum"))).alias("band_sum"), R.valid_pixel(F.col("spectrum"), D.CONTRACT).cast("int").alias("valid"))


@query
def valid_count(spark, sf_dir) -> DataFrame:
    return D.raster(spark, sf_dir).agg(F.count("*").alias("n_pixels"), F.count_if(R.valid_pixel(F.col("spectrum"), D.CONTRACT)).alias("n_valid"))


@query
def pixel_affine(spark, sf_dir) -> DataFrame:
    c = D.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    fr, fc = R.fractional_pixel(D.BALANCE_GT, F.col("x"), F.col("y"))
    row, col = R.pixel(D.BALANCE_GT, F.col("x"), F.col("y"))
    return c.select("c_custkey", r(fr).alias("frow"), r(fc).alias("fcol"), row.alias("row"), col.alias("col"), R.in_bounds(row, col, 400, 300).cast("int").alias("inside"))


@query
def geotransform_check(spark, sf_dir) -> DataFrame:
    gt = F.array(F.col("c_acctbal"), F.lit(2.0), F.lit(0.5), F.col("c_custkey").cast("double"), F.lit(-0.5), F.lit(3.0))
    g = R.geotransform_checked(gt)
    return D.table(spark, sf_dir, "customer").select("c_custkey", (g[1] * g[5] - g[2] * g[4]).alias("det"))


@query
def utm_lonlat(spark, sf_dir) -> DataFrame:
    """Map coordinates of zone 33, to 300 km beside its meridian and from the equator to 81 degrees."""
    c = D.table(spark, sf_dir, "customer").select("c_custkey", (500_000 + 30 * F.col("c_acctbal")).alias("e"), (1000.0 * (F.col("c_custkey") % 9000)).alias("n"))
    lon, lat = projection.utm_to_lonlat(F.col("e"), F.col("n"), 33)
    return c.select("c_custkey", r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query
def l2_normalize(spark, sf_dir) -> DataFrame:
    v = V.l2_normalized(F.col("spectrum"))
    return D.raster(spark, sf_dir).select("id", r(F.get(v, F.lit(0))).alias("v0"), r(F.get(v, F.lit(63))).alias("v63"), r(V.total(v)).alias("v_sum"))


@query
def paired_cosine(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    other = F.transform("spectrum", lambda x: F.round(x, 1))
    return px.select("id", r(V.cosine(F.col("spectrum"), other)).alias("cosine"), r(V.max_abs_difference(F.col("spectrum"), other)).alias("max_abs"))


@query
def lower_bound_ratio(spark, sf_dir) -> DataFrame:
    p = D.table(spark, sf_dir, "part")
    return p.select("p_partkey", T.lower_bound_ratio(F.col("p_retailprice"), F.col("p_size")).cast("double").alias("ratio"))


@query
def layer_classify(spark, sf_dir) -> DataFrame:
    rules = [("prefix", "red", "warm"), ("prefix", "blue", "cold"), ("infix", "widget", "part"), ("suffix", "ring", "round"), ("infix", "", "other")]
    return D.table(spark, sf_dir, "part").groupBy(T.classify(F.col("p_name"), rules).alias("grp")).agg(F.count("*").alias("n"))


@query
def name_tags(spark, sf_dir) -> DataFrame:
    c = D.table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"), F.concat(F.lit("a+"), F.col("c_custkey").cast("string"))).alias("scene"))
    part = T.scene_parts(F.col("scene"))
    return c.select("c_custkey", part["batch"].alias("batch"), part["date"].alias("date"), part["sid"].alias("sid"), T.tag(F.col("scene")).alias("tag"), T.scene_paths(F.col("scene"), "/data")["raster"].alias("path"))


# Encoder


def _linear():
    """A linear encoder with weights of a rule, exact in single precision for what encode_linear gives it."""
    i, j = np.arange(D.BANDS)[:, None], np.arange(8)[None, :]
    weights = ((7 * i + 3 * j) % 11 - 5).astype(np.float32)
    return lambda x: x @ weights


@query
def encode_linear(spark, sf_dir) -> DataFrame:
    """Checked vectors through an encoder, one a task; every seventh vector is missing and stays so."""
    steps = F.transform("embedding", lambda x: (F.floor(x * 256) / 256).cast("float"))
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 3, steps).alias("v"))
    out = encode.encode(encode.checked(e, "v", "array<float>", D.BANDS), "v", _linear, batch=100)
    return out.select("vec_id", *(F.get("feature", F.lit(k)).cast("double").alias(f"f{k}") for k in range(8)))


# Grid


@query
def band_stats(spark, sf_dir) -> DataFrame:
    return grid.band_stats(D.raster(spark, sf_dir)).select("band", r("mean").alias("mean"), r("std").alias("std"))


@query
def standardize(spark, sf_dir) -> DataFrame:
    z = grid.standardized(D.raster(spark, sf_dir))
    return z.select("id", F.posexplode("spectrum").alias("band", "z")).select("id", "band", r("z").alias("z"))


@query
def patch3x3(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    p = grid.patches(px, grid.masked(px, D.CONTRACT), D.BANDS)
    return p.select("row", "col", F.size("patch").alias("n"), r(V.total(F.col("patch"))).alias("total"), r(V.total(F.slice("patch", 1, 9))).alias("band0"), F.size(F.filter("patch", lambda x: x == 0)).alias("n_zero"))


@query
def fused_patch(spark, sf_dir) -> DataFrame:
    p = grid.standardized_patches(D.raster(spark, sf_dir), D.CONTRACT, D.BANDS)
    return p.select("row", "col", r(V.total(F.transform("patch", lambda x, i: x * (i % 7)))).alias("weighted"))


@query
def eligible_points(spark, sf_dir) -> DataFrame:
    valid = grid.masked(D.raster(spark, sf_dir), D.CONTRACT)
    return grid.eligible(D.located(D.cloud(spark, sf_dir)), valid).select("id", "row", "col")


@query
def sample_points(spark, sf_dir) -> DataFrame:
    valid = grid.masked(D.raster(spark, sf_dir), D.CONTRACT)
    points = grid.eligible(D.located(D.cloud(spark, sf_dir)), valid)
    return grid.sample(points, "id", 50, D.CONTRACT.seed).select("id", "row", "col")


@query
def split_samples(spark, sf_dir) -> DataFrame:
    return grid.split(D.raster(spark, sf_dir).select("id"), "id", 100, 50).groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query
def window_cover(spark, sf_dir) -> DataFrame:
    valid = grid.masked(D.raster(spark, sf_dir), D.CONTRACT)
    return grid.covered(D.located(D.cloud(spark, sf_dir)), valid, 1).select("row", "col")


@query
def pixel_index(spark, sf_dir) -> DataFrame:
    """Compact row-major index of valid pixels."""
    return grid.pixel_index(grid.masked(D.raster(spark, sf_dir), D.CONTRACT)).select("row", "col", "idx")


# Matching


def _sides(spark, sf_dir):
    """Every pixel as a point and as a pixel; a point never matches itself."""
    px = D.raster(spark, sf_dir).withColumn("v", V.l2_normalized(F.col("spectrum")))
    return px, px, px


def _shown(df, name, *more):
    m = F.col(name)
    return df.select("id", m["row"].alias("row"), m["col"].alias("col"), r(m["cosine"]).alias("cosine"), r(m["displacement"]).alias("displacement"), *more)


@query
def window_match(spark, sf_dir) -> DataFrame:
    points, pixels, _ = _sides(spark, sf_dir)
    return _shown(match.window_match(points, grid.masked(pixels, D.CONTRACT), D.RADIUS, {"best": match.cosine_score}, own=False), "best")


BOTH = {"plain": match.cosine_score, "spatial": match.penalized_score(0.2, D.RADIUS)}


@query
def window_match_multi(spark, sf_dir) -> DataFrame:
    points, pixels, _ = _sides(spark, sf_dir)
    found = match.window_match(points, pixels, D.RADIUS, BOTH, own=False)
    return _shown(found, "plain", F.col("spatial.row").alias("row2"), F.col("spatial.col").alias("col2"), r("spatial.score").alias("score2"))


@query
def match_margin(spark, sf_dir) -> DataFrame:
    points, pixels, _ = _sides(spark, sf_dir)
    return match.match_margin(points, grid.masked(pixels, D.CONTRACT), 1, own=False).select("id", r("top1").alias("top1"), r("top2").alias("top2"), r("margin").alias("margin"))


@query
def match_agreement(spark, sf_dir) -> DataFrame:
    points, pixels, _ = _sides(spark, sf_dir)
    t = match.agreement(match.window_match(points, pixels, D.RADIUS, BOTH, own=False), "plain", "spatial")
    return t.select("n", r("agreement").alias("agreement"), r("mean_gap").alias("mean_gap"), r("median_gap").alias("median_gap"))


@query
def spectrum_error(spark, sf_dir) -> DataFrame:
    points, pixels, px = _sides(spark, sf_dir)
    found = match.window_match(points, pixels, D.RADIUS, {"best": match.cosine_score}, own=False)
    t = validate.finite_summary(match.spectrum_errors(found, "best", px, px), [], "error")
    return t.select("n", r("mean").alias("mean"), r("median").alias("median"))


@query
def variant_report(spark, sf_dir) -> DataFrame:
    """Matching of valid pixels in full precision against a run on rounded spectra."""
    points, pixels, px = _sides(spark, sf_dir)
    rounded = px.withColumn("v", V.l2_normalized(F.transform("spectrum", lambda x: F.round(x, 2))))
    found = match.window_match(points, grid.masked(pixels, D.CONTRACT), 1, BOTH, own=False)
    base = match.window_match(rounded, grid.masked(rounded, D.CONTRACT), 1, BOTH, own=False)
    t = match.variant_report(found, base, list(BOTH), px, px)
    return t.select("variant", "n", "n_none", *(r(c).alias(c) for c in t.columns[3:]))


@query
def near_tie_check(spark, sf_dir) -> DataFrame:
    points, pixels, _ = _sides(spark, sf_dir)
    found = match.window_match(points, pixels, D.RADIUS, BOTH, own=False)
    differing = found.where(match.differing(found, "plain", "spatial"))
    return validate.near_ties(differing, match.match_margin(points, pixels, D.RADIUS, own=False), 0.02).select("n", "n_near", F.col("all_near").cast("int").alias("all_near"))


# Neighbours


def _queries(points):
    """Every row whose id is divisible by 20, against all rows."""
    return points.where("id % 20 = 0")


@query
def knn_canonical(spark, sf_dir) -> DataFrame:
    points = D.cloud(spark, sf_dir)
    return nearest.knn(_queries(points), points, 15).select("id", "rank", "nbr", r("d2").alias("d2"))


@query
def knn_offsets(spark, sf_dir) -> DataFrame:
    points = D.cloud(spark, sf_dir)
    o = nearest.neighbour_offsets(_queries(points), points, 15).select("id", F.posexplode("offsets").alias("k", "o"))
    return o.select("id", "k", r("o.dx").alias("dx"), r("o.dy").alias("dy"), r("o.dz").alias("dz"))


@query
def knn_ties(spark, sf_dir) -> DataFrame:
    points = D.cloud(spark, sf_dir)
    found, other = (nearest.knn(_queries(points), points, 16, last=last) for last in (False, True))
    return nearest.tie_census(found, 15, other)


@query
def bbox(spark, sf_dir) -> DataFrame:
    return nearest.bounding_box(D.cloud(spark, sf_dir))


@query
def nearest_linf(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir).select("id", F.col("spectrum").alias("v"))
    found = nearest.all_pairs_top(_queries(px), px, 1, metric="linf")
    return found.select("id", "other", r(-F.col("score")).alias("distance"))


def _two_runs(spark, sf_dir):
    px = D.raster(spark, sf_dir)
    return px.select("id", F.col("spectrum").alias("v")), px.select("id", F.transform("spectrum", lambda x: F.round(x, 2)).alias("v"))


@query
def accuracy_report(spark, sf_dir) -> DataFrame:
    t = validate.accuracy_report(*_two_runs(spark, sf_dir))
    return t.select("n", *(r(c).alias(c) for c in t.columns[1:]))


@query
def rank_agreement(spark, sf_dir) -> DataFrame:
    ref, test = _two_runs(spark, sf_dir)
    unit = lambda d: d.select("id", V.l2_normalized(F.col("v")).alias("v"))
    return validate.rank_agreement(unit(ref), unit(test), 5).select("n", r("agreement").alias("agreement"))


@query
def margin_stats(spark, sf_dir) -> DataFrame:
    ref, _ = _two_runs(spark, sf_dir)
    t = validate.margins(ref.select("id", V.l2_normalized(F.col("v")).alias("v")))
    return t.select("n", *(r(c).alias(c) for c in t.columns[1:]))


# Equality and gates


@query
def bit_equality(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir).select("id", "row", "col", "spectrum")
    other = px.where("id % 50 <> 7").withColumn("col", F.when(F.col("id") % 3 == 0, F.col("col") + 1).otherwise(F.col("col")))
    out = validate.equality(px, other, ["id"], ["row", "col", "spectrum"])
    return out.select("name", "n_both", "n_missing", "n_differing", F.col("equal").cast("int").alias("equal"))


@query
def differing_elements(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    a, b = F.transform("spectrum", lambda x: F.round(x, 1)), F.transform("spectrum", lambda x: F.round(x * 1.01, 1))
    return px.select("id", V.count_differing(a, b).alias("n_differing"), V.same_members(a, F.reverse(a)).cast("int").alias("same_members"), r(V.max_abs_difference(a, b)).alias("max_abs"))


@query
def threshold_gate(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    modes = [("fp32", 6), ("fp16", 2), ("int8", 1)]
    reports = []
    for mode, digits in modes:
        test = px.select("id", F.transform("spectrum", _rounder(digits)).alias("v"))
        reports.append(validate.accuracy_report(px.select("id", F.col("spectrum").alias("v")), test).select(F.lit(mode).alias("mode"), "min_cosine", "max_abs"))
    limits = spark.createDataFrame([("fp32", 0.999, 1e-4), ("fp16", 0.999999, None), ("int8", None, None)], "mode string, least_cosine double, most_abs double")
    out = validate.gate(reports[0].unionByName(reports[1]).unionByName(reports[2]), limits)
    return out.select("mode", r("min_cosine").alias("min_cosine"), r("max_abs").alias("max_abs"), F.col("passed").cast("int").alias("passed"), F.col("report_only").cast("int").alias("report_only"))


def _rounder(digits):
    return lambda x: F.round(x, digits)


@query
def declared_ratio(spark, sf_dir) -> DataFrame:
    p = D.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", F.lit("cached").alias("from_a"), F.lit("cached").alias("from_b"))
    return validate.guarded_ratio(p.withColumn("p_size", F.col("p_size").cast("double")), "p_retailprice", "p_size", "from_a", "from_b").select("p_partkey", r("ratio").alias("ratio"))


# Timings and telemetry


@query
def latency_stats(spark, sf_dir) -> DataFrame:
    t = runs.latency_stats(D.timings(spark, sf_dir), ["stage"], batch=64)
    return t.select("stage", "n", *(r(c).alias(c) for c in t.columns[2:]))


@query
def stage_medians(spark, sf_dir) -> DataFrame:
    t = runs.stage_medians(D.timings(spark, sf_dir), ["round"])
    return t.select("round", "stage", r("median").alias("median"), r("least").alias("least"))


@query
def sum_of_medians(spark, sf_dir) -> DataFrame:
    t = runs.sum_of_medians(D.timings(spark, sf_dir), ["round"], ["view", "error"])
    return t.select("round", r("with_io").alias("with_io"), r("without_io").alias("without_io"))


@query
def median_of_run_totals(spark, sf_dir) -> DataFrame:
    t = runs.median_of_sums(D.timings(spark, sf_dir), ["round"])
    return t.select("round", r("median").alias("median"), "n_runs")


@query
def phase_energy(spark, sf_dir) -> DataFrame:
    s = D.telemetry(spark, sf_dir)
    t = runs.energy(s, D.phases(s))
    return t.select(F.col("start").cast("bigint").alias("start"), "n_samples", *(r(c).alias(c) for c in t.columns[3:]))


@query
def window_expand_join(spark, sf_dir) -> DataFrame:
    s = D.telemetry(spark, sf_dir)
    met = runs.sampled_in(s, D.phases(s), -1.0, -1.0)
    return met.groupBy("name", F.col("start").cast("bigint").alias("start")).agg(F.count("*").alias("n"), r(F.avg("power")).alias("mean_power"))


@query
def busy_union(spark, sf_dir) -> DataFrame:
    s = D.telemetry(spark, sf_dir).select("day", "kind", F.col("s").alias("start"), (F.col("s") + F.col("power")).alias("stop"))
    t = runs.busy(s, ["day", "kind"], (F.col("day") * 86400).cast("double"), (F.col("day") * 86400 + 86400).cast("double"))
    return t.select("day", "kind", r("busy", 4).alias("busy"), r("total", 4).alias("total"), "n_islands", "n_whole")


@query
def telemetry_parse(spark, sf_dir) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "MM-dd-yyyy HH:mm:ss")
    power = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" VDD_IN "), F.col("user_id").cast("string"), F.lit("mW"))).otherwise("")
    ram = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit(" RAM "), F.col("user_id").cast("string"), F.lit("/7620MB"))).otherwise("")
    line = F.concat(stamp, ram, F.lit(" tj@"), F.col("value").cast("string"), F.lit("C"), power, F.lit(" GR3D_FREQ 5%"))
    parsed = e.select("event_id", *T.telemetry_fields(line, "+0800")).where("t is not null and ram_mb is not null")
    return parsed.select("event_id", F.unix_seconds("t").alias("t"), "ram_mb", "power_mw", r("tj").alias("tj"), "util_pct")


@query
def log_scrape(spark, sf_dir) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    line = F.concat(F.lit("[I] GPU Compute Time: min = 0.1 ms, median = "), F.col("value").cast("string"), F.lit(" ms"))
    snap = T.device_snapshot(F.concat_ws(", ", F.lit("gpu"), F.col("user_id").cast("string"), F.lit("7000"), F.lit("40"), F.col("value").cast("string"), F.lit("3")))
    return e.select("event_id", r(T.p50_line(line)).alias("p50"), snap["sm_mhz"].alias("sm_mhz"), r(snap["power_w"]).alias("power_w"))


@query
def temperature_max(spark, sf_dir) -> DataFrame:
    t = D.telemetry(spark, sf_dir).select("day", F.when(F.col("kind") == "error", F.col("power")).alias("tj"))
    return runs.peak(t, ["day"], "tj").select("day", r("most").alias("tj_max"), "n")


@query
def cold_start(spark, sf_dir) -> DataFrame:
    t = runs.cold_start(_totals(spark, sf_dir), ["stage"], "rep", "t")
    return t.select("stage", r("median").alias("median"), r("least").alias("least"), r("most").alias("most"), "n", r(F.col("all")[0]).alias("first"), r(F.element_at("all", -1)).alias("last"))


@query
def histogram(spark, sf_dir) -> DataFrame:
    return runs.histogram(D.table(spark, sf_dir, "part"), ["p_type", "p_brand"])


@query
def near_optimal_pick(spark, sf_dir) -> DataFrame:
    p = D.table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size", "p_retailprice")
    return runs.near_optimal(p, ["p_type"], "p_retailprice", "p_size", 0.05)


@query
def group_ffill(spark, sf_dir) -> DataFrame:
    t = D.timings(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("stage")).alias("grp"))
    return runs.filled_forward(t, ["user_id"], "event_id", "grp")


def _totals(spark, sf_dir):
    return D.timings(spark, sf_dir).groupBy("stage", "rep").agg(F.sum("ms").alias("t"))


@query
def prev_config_diff(spark, sf_dir) -> DataFrame:
    return runs.previous_config(_totals(spark, sf_dir), ["stage"], "rep", "t").select("stage", "rep", r("previous").alias("previous"), r("diff").alias("diff"))


@query
def speedup_vs_first(spark, sf_dir) -> DataFrame:
    return runs.previous_config(_totals(spark, sf_dir), ["stage"], "rep", "t").select("stage", "rep", r("t").alias("t"), r("speedup").alias("speedup"))


@query
def greedy_prefix(spark, sf_dir) -> DataFrame:
    return runs.until_threshold(_totals(spark, sf_dir).withColumn("t", F.round("t", 2)), ["stage"], "t", "rep", 5000.0).select("stage", "rep", "rank", r("t").alias("t"))


@query
def pairwise_build_diff(spark, sf_dir) -> DataFrame:
    t = runs.pairwise(_totals(spark, sf_dir), ["stage"], "rep", "t")
    return t.select("stage", "n", r("std").alias("std"), r("range").alias("range"), F.col("all_there").cast("int").alias("all_there"))


@query
def runner_overhead(spark, sf_dir) -> DataFrame:
    t = D.timings(spark, sf_dir)
    o = runs.overhead(t.where("round = 'fwd'"), t.where("round = 'rev'").withColumn("ms", F.col("ms") * 0.8), ["stage"], 0.2)
    return o.select("stage", r("wall").alias("wall"), r("device").alias("device"), r("overhead").alias("overhead"), r("share").alias("share"), F.col("recommended").cast("int").alias("recommended"))


@query
def rounds_agree(spark, sf_dir) -> DataFrame:
    t = runs.rounds_agree(D.timings(spark, sf_dir), ["stage", "rep"], "ms", 0.05)
    return t.select("stage", "rep", r("fwd").alias("fwd"), r("rev").alias("rev"), r("mean").alias("mean"), r("relative").alias("relative"), F.col("agrees").cast("int").alias("agrees"))


@query
def layout_rows(spark, sf_dir) -> DataFrame:
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("vals"))
    return runs.unified_layout(c, ["balance", "nation"]).select("key", "variant", "value")


@query
def deterministic_runs(spark, sf_dir) -> DataFrame:
    """Whether every repetition of a stage took part and took the same number of calls."""
    t = runs.same_counts(D.timings(spark, sf_dir), ["stage"], "rep", 100)
    return t.select("stage", "n_counts", F.col("all_busy").cast("int").alias("all_busy"), F.col("same").cast("int").alias("same"))


# Reports in full


@query
def accuracy_report_full(spark, sf_dir) -> DataFrame:
    ref, test = (d.select("id", V.l2_normalized(F.col("v")).alias("v")) for d in _two_runs(spark, sf_dir))
    t = validate.full_accuracy_report(ref, test)
    return t.select("n", *(r(c).alias(c) for c in t.columns[1:]))


@query
def build_max_abs(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    builds = [px.select(F.lit(d).alias("build"), "id", F.transform("spectrum", _rounder(d)).alias("v")) for d in (1, 2, 3)]
    return validate.pairwise_max_abs(builds[0].unionAll(builds[1]).unionAll(builds[2])).select("a", "b", "n", r("max_abs").alias("max_abs"))


@query
def unknown_names(spark, sf_dir) -> DataFrame:
    asked = D.table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string")).alias("name"))
    known = asked.where("name not like '%_3' and name not like 'view%'")
    return validate.unknown_names(asked, known)


@query
def patch_verdict(spark, sf_dir) -> DataFrame:
    px = D.raster(spark, sf_dir)
    expected = F.when(F.col("id") % 11 == 0, F.slice("spectrum", 1, 5)).otherwise(F.transform("spectrum", lambda x: F.round(x, 4)))
    return px.select("id", V.within(F.col("spectrum"), expected, 4e-5).cast("int").alias("passed"))


@query
def l2_above(spark, sf_dir) -> DataFrame:
    v = V.l2_normalized_above(F.transform("spectrum", lambda x: x * F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0)), 0.5)
    return D.raster(spark, sf_dir).select("id", r(F.get(v, F.lit(0))).alias("v0"), r(V.total(v)).alias("v_sum"))


@query
def nearest_norm(spark, sf_dir) -> DataFrame:
    """Nearest other row by difference of norms, as a search on one axis."""
    norm = F.round(F.sqrt(V.dot(F.col("spectrum"), F.col("spectrum"))), 6)
    px = D.raster(spark, sf_dir).select("id", norm.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return nearest.knn(_queries(px), px, 1).select("id", "nbr", r(F.abs("dx")).alias("gap"))


@query
def idle_window(spark, sf_dir) -> DataFrame:
    s = D.telemetry(spark, sf_dir)
    starts = s.select(F.lit("idle").alias("name"), F.col("s").alias("start")).where("id % 10 = 0" if "id" in s.columns else "true").distinct()
    t = runs.idle_power(s, starts, 3600.0)
    return t.select(r("start").alias("start"), "n", r("mean_power").alias("mean_power"))


@query
def rounds_all_agree(spark, sf_dir) -> DataFrame:
    t = runs.all_rounds_agree(D.timings(spark, sf_dir), ["stage"], ["rep"], "ms", 0.1)
    return t.select("stage", "n", "n_agree", F.col("all_agree").cast("int").alias("all_agree"))


@query
def config_ratio(spark, sf_dir) -> DataFrame:
    t = runs.ratio_to_config(D.timings(spark, sf_dir).withColumn("rep", F.col("rep").cast("string")), ["stage"], "rep", "0", "ms")
    return t.select("stage", "rep", r("mean").alias("mean"), r("ratio").alias("ratio"))


@query
def overhead_vs_benchmark(spark, sf_dir) -> DataFrame:
    wall = D.timings(spark, sf_dir).withColumn("n_items", F.lit(64))
    bench = spark.createDataFrame([("view", 100.0), ("click", 200.0), ("error", None)], "stage string, us double")
    t = runs.overhead_against(wall, bench, ["stage"])
    return t.select("stage", r("wall_us").alias("wall_us"), r("overhead_us").alias("overhead_us"), r("ratio").alias("ratio"))


@query
def finite_gap(spark, sf_dir) -> DataFrame:
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 != 0, F.col("ms"))
    return validate.finite_summary(D.timings(spark, sf_dir).withColumn("x", x), ["stage"], "x").select("stage", "n", r("mean").alias("mean"), r("median").alias("median"))
