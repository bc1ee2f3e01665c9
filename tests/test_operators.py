"""Hand-computed fixtures and differential tests of the core operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.contract import Contract
from terralign.functions import projection, raster, text, vectors
from terralign.operators import grid, match, nearest, runs, validate

RASTER = "scene string, row int, col int, spectrum array<double>"


def cube_rows(cube, scene="s"):
    return [(scene, r, c, [float(x) for x in cube[:, r, c]]) for r in range(cube.shape[1]) for c in range(cube.shape[2])]


def test_mask_is_strict_and_guards_the_denominator(spark):
    c = Contract(bands=4, red=0, nir=1, ndvi_threshold=0.5, nodata_epsilon=0.25)
    rows = [("s", 0, 0, [1.0, 3.0, 0.0, 0.0]), ("s", 0, 1, [1.0, 3.5, 0.0, 0.0]), ("s", 0, 2, [0.0, 0.0, 1.0, 1.0]), ("s", 1, 0, [0.0, 0.25, 0.0, 0.0]), ("s", 1, 1, [0.0, 0.5, 0.0, 0.0]), ("s", 1, 2, [-1.0, 1.0, 0.0, 5.0])]
    got = spark.createDataFrame(rows, RASTER).select("row", "col", raster.ndvi(F.col("spectrum"), 0, 1).alias("n"), raster.valid_pixel(F.col("spectrum"), c).alias("v")).collect()
    assert {(r.row, r.col): r.v for r in got} == {(0, 0): False, (0, 1): True, (0, 2): False, (1, 0): False, (1, 1): True, (1, 2): False}
    assert {(r.row, r.col): r.n for r in got}[0, 2] == 0 and {(r.row, r.col): r.n for r in got}[1, 2] == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_standardized_patches_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    cube = rng.standard_normal((5, 4, 6))
    mean, std = cube.mean(axis=(1, 2), keepdims=True), cube.std(axis=(1, 2), keepdims=True)
    z = np.pad((cube - mean) / (std + 1e-8), ((0, 0), (1, 1), (1, 1)))
    c = Contract(bands=5, red=0, nir=1, ndvi_threshold=0.0, nodata_epsilon=-100.0)
    got = grid.standardized_patches(spark.createDataFrame(cube_rows(cube), RASTER), c, 5).collect()
    valid = {(r, k) for r in range(4) for k in range(6) if (d := cube[1, r, k] + cube[0, r, k]) and abs(d) > 1e-12 and (cube[1, r, k] - cube[0, r, k]) / d > 0 and cube[:, r, k].sum() > -100}
    assert {(r.row, r.col) for r in got} == valid
    for r in got:
        assert np.allclose(r.patch, z[:, r.row : r.row + 3, r.col : r.col + 3].ravel())
    with pytest.raises(ValueError):
        grid.patches(None, None, 5, 4)


@pytest.mark.parametrize("size,side", [(3, 4), (5, 32), (3, 2)])
def test_patches_across_tiles(spark, size, side):
    """Several scenes, holes, negative places, null spectra and bands, repeated centres, centres beside and off the grid."""
    rng, h = np.random.default_rng(size), size // 2
    cells = {(s, r, c): rng.standard_normal(3).tolist() for s in "ab" for r in range(-3, 9) for c in range(7) if rng.random() < 0.8}
    cells[("a", 0, 0)], cells[("a", 1, 1)] = None, [1.0, None, 2.0]
    centres = [(s, r, c) for s, r, c in cells if rng.random() < 0.5] * 2 + [("a", 9, 3), ("a", 40, 40), ("z", 0, 0), (None, 0, 0), ("b", None, 1)]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], RASTER).repartition(3)
    got = {(r.scene, r.row, r.col): list(r.patch) for r in grid.patches(df, spark.createDataFrame(centres, "scene string, row int, col int"), 3, size, side).collect()}
    want = {}
    for s, r, c in set(centres):
        if None not in (s, r, c) and (near := [(s, r + a, c + b) for a in range(-h, h + 1) for b in range(-h, h + 1)]) and any(k in cells for k in near):
            want[s, r, c] = [((cells.get(k) or [0.0] * 3)[band] or 0.0) for band in range(3) for k in near]
    assert got == want


def test_patches_move_a_spectrum_about_once(spark):
    raster_ = spark.range(96 * 96).select(F.lit("s").alias("scene"), F.expr("cast(id div 96 as int)").alias("row"), F.expr("cast(id % 96 as int)").alias("col"))
    from terralign.operators.tiles import tiled

    assert tiled(raster_, 32, 1).count() <= 1.15 * 96 * 96 and tiled(raster_, 64, 1).count() <= 1.3 * 96 * 96


def test_affine_floor_and_errors(spark):
    df = spark.createDataFrame([(-0.5, -0.5), (3.0, 0.0), (0.0, 9.99)], "x double, y double")
    row, col = raster.pixel((0, 1, 0, 10, 0, -1), F.col("x"), F.col("y"))
    got = df.select(row.alias("r"), col.alias("c"), raster.in_bounds(row, col, 10, 3).alias("i")).collect()
    assert [(g.r, g.c, g.i) for g in got] == [(10, -1, False), (10, 3, False), (0, 0, True)]
    for bad in ((0, 1, 2, 0, 2, 4), (0, 1, 0, 0, 0, math.nan), (1, 2, 3)):
        with pytest.raises(ValueError):
            raster.checked_geotransform(bad)
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(math.nan, 1.0)], "x double, y double").select(*raster.pixel((0, 1, 0, 0, 0, 1), F.col("x"), F.col("y"))).collect()
    with pytest.raises(Exception, match="geotransform"):
        spark.createDataFrame([([0.0, 1.0, 2.0, 0.0, 2.0, 4.0],)], "g array<double>").select(raster.geotransform_checked(F.col("g"))).collect()


def test_window_ties_clipping_and_none(spark):
    pixels = [("s", r, c, [1.0, 0.0]) for r in range(5) for c in range(5)]
    p = spark.createDataFrame(pixels, "scene string, row int, col int, v array<double>")
    q = spark.createDataFrame([(1, "s", 0, 0, [1.0, 0.0]), (2, "s", 2, 2, [1.0, 0.0]), (3, "s", 9, 9, [1.0, 0.0]), (4, "t", 2, 2, [1.0, 0.0]), (5, "s", -1, 4, [0.0, 1.0])], "id int, scene string, row int, col int, v array<double>")
    got = {r.id: r for r in match.window_match(q, p, 1, {"a": match.cosine_score, "b": match.penalized_score(1.0, 1), "c": lambda k, d: F.lit(float("nan"))}).collect()}
    assert (got[1].a.row, got[1].a.col) == (0, 0) and (got[2].a.row, got[2].a.col) == (1, 1)
    assert (got[2].b.row, got[2].b.col, got[2].b.displacement) == (2, 2, 0.0)
    assert got[3].a is None and got[4].a is None and got[2].c is None and (got[5].a.row, got[5].a.col) == (0, 3)
    n = match.candidates(q, p, 1).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in n} == {1: 4, 2: 9, 5: 2}
    margin = {r.id: r.margin for r in match.match_margin(q, p.where("row = 0 and col = 0"), 1).collect()}
    assert margin[1] is None and margin[3] is None


@pytest.mark.parametrize("seed", range(3))
def test_window_match_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    cells = [(r, c) for r in range(9) for c in range(7) if rng.random() < 0.7]
    v = {k: rng.standard_normal(3) for k in cells}
    points = [(i, "s", int(rng.integers(-2, 11)), int(rng.integers(-2, 9)), rng.standard_normal(3).tolist()) for i in range(30)]
    p = spark.createDataFrame([("s", r, c, v[r, c].tolist()) for r, c in cells], "scene string, row int, col int, v array<double>")
    q = spark.createDataFrame(points, "id int, scene string, row int, col int, v array<double>").repartition(3)
    got = {r.id: r.a and (r.a.row, r.a.col) for r in match.window_match(q, p, 2, {"a": match.cosine_score}).collect()}
    for i, _, r0, c0, x in points:
        near = [(-float(np.dot(x, v[k])), k) for k in cells if abs(k[0] - r0) <= 2 and abs(k[1] - c0) <= 2]
        assert got[i] == (min(near)[1] if near else None)


def test_tiles_match_as_columns_do(spark, monkeypatch):
    """Tile products give what the joined pairs give: several tiles and scenes, equal ids in two scenes, ties, odd vectors and places."""
    monkeypatch.setattr(match, "SIDE", 6)
    rng = np.random.default_rng(9)
    pixels = [(s, r, c, rng.integers(-2, 3, 4).astype(float).tolist()) for s in "ab" for r in range(-4, 14) for c in range(11) if rng.random() < 0.7]
    pixels += [("a", 20, 20, None), ("a", 20, 21, [1.0, None, 1.0, 1.0]), ("a", 20, 22, [1.0]), ("a", 21, 21, [math.nan] * 4)]
    points = [(i, s, int(r), int(c), rng.integers(-2, 3, 4).astype(float).tolist()) for s in "ab" for i, (r, c) in enumerate(rng.integers(-6, 16, (60, 2)))]
    points += [(900, "a", 20, 21, [1.0] * 4), (901, "a", 0, 0, None), (902, None, 0, 0, [1.0] * 4), (903, "a", None, 0, [1.0] * 4), (904, "c", 0, 0, [1.0] * 4)]
    q = spark.createDataFrame(points, "id int, scene string, row int, col int, v array<double>").repartition(3)
    p = spark.createDataFrame(pixels, "scene string, row int, col int, v array<double>")
    scores = {"a": match.cosine_score, "b": match.penalized_score(0.3, 2)}
    for own in (True, False):
        fast = match.window_match(q, p, 2, scores, own).select("id", "scene", "a", "b")
        joined = match.window_match(q, p, 2, scores | {"c": lambda k, d: F.lit(1.0)}, own).select("id", "scene", "a", "b")
        assert sorted(map(str, fast.collect())) == sorted(map(str, joined.collect()))
        assert fast.count() == len(points) and fast.where("a is not null").count() > 60
    two = match.candidates(q, p, 2).where("cosine is not null and not isnan(cosine)").groupBy("scene", "id").agg(F.sort_array(F.collect_list("cosine"), False).alias("s"))
    want = {(r.scene, r.id): list(r.s) for r in two.collect()}
    for r in match.match_margin(q, p, 2).collect():
        s = want.get((r.scene, r.id), [])
        assert (r.top1, r.top2) == ((s + [None, None])[0], (s + [None, None])[1]) and r.margin == (s[0] - s[1] if len(s) > 1 else None)


def test_spectrum_errors_of_two_scenes(spark):
    """The same ids and places in two scenes: one error a point, of its own scene."""
    pixels = [(s, 0, c, [float(c + k), 1.0]) for k, s in ((0, "a"), (10, "b")) for c in range(3)]
    p = spark.createDataFrame(pixels, "scene string, row int, col int, spectrum array<double>").withColumn("v", F.col("spectrum"))
    q = p.where("col = 1").withColumn("id", F.lit(7))
    found = match.window_match(q, p, 1, {"best": match.cosine_score}, own=False)
    got = sorted((r.scene, r.id, r.error) for r in match.spectrum_errors(found, "best", p, q).collect())
    assert got == [("a", 7, 1.0), ("b", 7, 1.0)]


@pytest.mark.parametrize("shape", ["grid", "random", "flat", "far"])
def test_knn_equals_brute_force(spark, shape):
    rng = np.random.default_rng(1)
    xyz = {"grid": np.array(list(itertools.product(range(4), range(4), range(2)))), "random": rng.standard_normal((60, 3)), "flat": np.c_[rng.integers(0, 5, (50, 2)), np.zeros(50)], "far": np.r_[rng.standard_normal((30, 3)), rng.standard_normal((3, 3)) + 1000]}[shape].astype(float)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double").repartition(3)
    got = {}
    for r in nearest.knn(df.where("id % 3 = 0"), df, 5).collect():
        got.setdefault(r.id, []).append((r.rank, r.nbr))
    for i in range(0, len(xyz), 3):
        d = xyz - xyz[i]
        order = sorted((float(a * a + b * b + c * c), j) for j, (a, b, c) in enumerate(d) if j != i)[:5]
        assert [n for _, n in sorted(got[i])] == [j for _, j in order]


@pytest.mark.parametrize("last", [False, True])
def test_knn_in_many_slices(spark, monkeypatch, last):
    """Dense and sparse places, far points, duplicates beyond a slice, odd coordinates: as by brute force, whatever the slices."""
    monkeypatch.setattr(nearest, "SLICE", 40)
    rng = np.random.default_rng(4)
    xyz = np.r_[rng.standard_normal((300, 3)) * 1e-3, rng.standard_normal((200, 3)), rng.standard_normal((20, 3)) * 1e6, np.tile([5.0, 5.0, 5.0], (150, 1)), rng.integers(0, 3, (80, 3))].astype(float)
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    odd = [(10_000, math.nan, 0.0, 0.0), (10_001, None, 0.0, 0.0), (10_002, 0.0, math.inf, 0.0), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "id long, x double, y double, z double").repartition(3)
    asked = df.where("id % 5 = 0 or id >= 10000").unionAll(spark.createDataFrame([(20_000, 1e9, -1e9, 0.0)], df.schema))
    got = {}
    for r in nearest.knn(asked, df, 6, last).collect():
        got.setdefault(r.id, []).append((r["rank"], r.nbr, r.d2))
    assert set(got) == {*range(0, len(xyz), 5), 20_000}
    for i, found in got.items():
        d = xyz - (xyz[i] if i < 20_000 else np.array([1e9, -1e9, 0.0]))
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        want = sorted((v, -j if last else j) for j, v in enumerate(d2) if j != i)[:6]
        assert [(n, v) for _, n, v in sorted(found)] == [(abs(j), v) for v, j in want]


def test_knn_looks_at_few_points(spark, monkeypatch):
    """10^5 points of which half lie in a thousandth of the space: a query visits few slices and compares few points."""
    monkeypatch.setattr(nearest, "SLICE", 2000)
    rng = np.random.default_rng(5)
    xyz = np.r_[rng.random((50_000, 3)), 0.3 + 0.01 * rng.random((50_000, 3))]
    blocks = nearest.Blocks(np.arange(3000), xyz[-3000:][np.lexsort(xyz[-3000:].T)])
    df = spark.createDataFrame(np.c_[np.arange(len(xyz)), xyz].tolist(), "id double, x double, y double, z double").withColumn("id", F.col("id").cast("long"))
    real, rows = nearest._in_slices, []

    def counted(visits, dealt, k, sign):
        rows.append(visits.count())
        return real(visits, dealt, k, sign)

    monkeypatch.setattr(nearest, "_in_slices", counted)
    asked = df.where("id % 50 = 0")
    assert nearest.knn(asked, df, 15).groupBy("id").count().where("count = 15").count() == 2000
    assert rows[0] == 2000 and sum(rows) < 10 * 2000  # of 50 slices
    order = np.lexsort(np.floor(blocks.xyz * 3000).T)
    near = nearest.Blocks(blocks.ids[order], blocks.xyz[order])
    near.nearest(7, near.xyz[1500], 15, 1, np.inf)
    assert near.examined < 3000


def test_offsets_pad_and_keep_duplicates(spark):
    schema = "id long, x double, y double, z double"
    lone = spark.createDataFrame([(7, 1.0, 2.0, 3.0)], schema)
    assert [tuple(o) for o in nearest.neighbour_offsets(lone, lone, 3).first().offsets] == [(0, 0, 0)] * 3
    two = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 2.0)], schema)
    assert [tuple(o) for o in nearest.neighbour_offsets(two, two, 3).orderBy("id").first().offsets] == [(0, 0, 2)] * 3
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(4)], schema)
    assert [r.nbr for r in nearest.knn(same.where("id = 2"), same, 3).orderBy("rank").collect()] == [0, 1, 3]
    assert nearest.knn(lone.limit(0), lone.limit(0), 3).count() == 0


@pytest.mark.parametrize("metric", ["dot", "linf"])
def test_all_pairs_visit_few_cells_of_clustered_vectors(spark, monkeypatch, metric):
    """30 clusters: what is written is base, queries, and the few visits whose bound reaches the floor; results as by brute force."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16)) * 10
    v = np.concatenate([c + 0.01 * rng.standard_normal((40, 16)) for c in centres])
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    real, written = nearest.cut, []

    def counted(d):
        out = real(d)
        if "cell" in d.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(nearest, "cut", counted)
    got = {(r.id, r["rank"]): r.other for r in nearest.all_pairs_top(df, df, 3, block=32, metric=metric).collect()}
    score = v @ v.T if metric == "dot" else -np.abs(v[:, None] - v[None]).max(axis=2)
    for i in range(len(v)):
        order = [j for j in np.argsort(-score[i], kind="stable") if j != i][:3]
        assert np.allclose([score[i, got[i, r + 1]] for r in range(3)], score[i, order], atol=1e-12)
    assert written[0] == written[1] == len(v) and written[2] < 4 * len(v)  # all with all would be 38 parts each


def test_all_pairs_leave_odd_vectors_out(spark):
    rows = [(i, [float(i), 1.0]) for i in range(9)] + [(20, None), (21, [math.nan, 1.0]), (22, [1.0]), (23, [1.0, None]), (24, [math.inf, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = nearest.all_pairs_top(df, df, 20, block=2).collect()
    assert {(r.id, r.other) for r in got} == {(i, j) for i in range(9) for j in range(9) if i != j}
    assert nearest.all_pairs_top(df.limit(0), df, 2).count() == nearest.all_pairs_top(df, df.limit(0), 2).count() == 0


def test_all_pairs_in_blocks(spark):
    v = np.random.default_rng(0).standard_normal((70, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    for metric, score in (("dot", v @ v.T), ("linf", -np.abs(v[:, None] - v[None]).max(axis=2))):
        got = {(r.id, r.rank): r.other for r in nearest.all_pairs_top(df, df, 3, block=16, metric=metric).collect()}
        for i in range(70):
            order = [j for j in np.argsort(-score[i], kind="stable") if j != i][:3]
            assert [got[i, k + 1] for k in range(3)] == order


def test_all_pairs_write_no_vector_for_each_visit(spark, monkeypatch):
    """Right-angled vectors, which nothing bounds: what is stored doesn't grow with the visits; in rounds as in one."""
    v = np.random.default_rng(5).standard_normal((600, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    real, stored = nearest.cut, []

    def counted(d):
        out = real(d)
        stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(nearest, "cut", counted)
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    want = {(i, r + 1): j for i in range(600) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:2])}
    for held in (32 << 20, 200 * 16 * 8):
        monkeypatch.setattr(nearest, "HELD", held)
        stored.clear()
        assert {(r.id, r["rank"]): r.other for r in nearest.all_pairs_top(df, df, 2, block=32).collect()} == want
        assert sum(n for c, n in stored if "v" in c) <= 4 * 600  # all with all would be 19 parts each
        assert len([c for c, _ in stored if "score" in c]) == (1 if held == 32 << 20 else 3)


def test_all_pairs_of_equal_vectors_are_in_order_of_id(spark):
    """Equal vectors have equal scores wherever they stand, so ties go by id; others that differ by a rounding don't."""
    rng = np.random.default_rng(8)
    some = rng.standard_normal((40, 64))
    v = np.concatenate([some] * 7)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    for block in (16, 2048):
        got = {(r.id, r["rank"]): r.other for r in nearest.all_pairs_top(df, df, 5, block=block).collect()}
        assert got == {(i, r + 1): j for i in range(280) for r, j in enumerate([j for j in range(i % 40, 280, 40) if j != i][:5])}


def test_rank_agreement_and_margins_of_equal_vectors(spark):
    """Each vector stands three times: the nearest is the copy of least id on both sides, and the margin is 0."""
    v = np.random.default_rng(9).standard_normal((50, 64))
    unit = lambda d: d.select("id", vectors.l2_normalized(F.col("v")).alias("v"))
    ref = unit(spark.createDataFrame([(i + 50 * c, x.tolist()) for c in range(3) for i, x in enumerate(v)], "id long, v array<double>"))
    assert tuple(validate.rank_agreement(ref, ref, 1).first()) == (150, 1.0)
    assert tuple(validate.rank_agreements(ref, ref, (1, 2)).first()) == (1.0, 1.0)
    told = validate.margins(ref).first()
    assert (told.n, told.mean, told.least) == (150, 0.0, 0.0)


def test_all_pairs_of_huge_tiny_and_zero_vectors(spark):
    """Single precision only rules out: scores beyond its range are ranked in double precision."""
    v = np.random.default_rng(4).standard_normal((60, 3)) * 10.0 ** np.arange(-60, 60, 2)[:, None]
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.id, r["rank"]): (r.other, r.score) for r in nearest.all_pairs_top(df, df, 3, block=8).collect()}
    for i in range(60):
        score = (v * v[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(60), -score)) if j != i][:3]
        assert [got[i, r + 1][0] for r in range(3)] == order


def test_idle_power_makes_no_pairs(spark, monkeypatch):
    """As by brute force on ties, edges, repeated rows and odd values; the rows scanned grow with samples and starts, not with their pairs."""
    rng = random.Random(3)
    times = [rng.choice([rng.uniform(0, 40), float(rng.randrange(40))]) for _ in range(400)]
    s = [(t, rng.choice([None, rng.uniform(0, 9), 5.0])) for t in times] + [(-3.0, math.nan), (None, 1.0), (math.nan, 1.0), (math.inf, 1.0), (100.0, None), (1e12, 4.0)]
    starts = [("a", t) for t in times[:60]] + [("b", times[0]), ("a", times[0]), ("a", -7.9), ("a", 95.5), ("a", None), ("a", math.nan), ("a", 60.0), ("a", 1e12 - 1)]
    ds, dq = spark.createDataFrame(s, "s double, power double"), spark.createDataFrame(starts, "name string, start double")
    real, scanned = runs.scan.scanned, []

    def counted(rows, *rest):
        scanned.append(rows.count())
        return real(rows, *rest)

    monkeypatch.setattr(runs.scan, "scanned", counted)
    for small in (1_000_000, 5):
        monkeypatch.setattr(runs.scan, "SMALL", small)
        got = {(r.name, r.start): (r.n, r.mean_power) for r in runs.idle_power(ds, dq, 5.0).collect()}
        want = {}
        for name, at in {x for x in starts if x[1] is not None and math.isfinite(x[1])}:
            inside = [p for t, p in s if t is not None and at <= t < at + 5.0]
            some = [p for p in inside if p is not None]
            if inside:
                want[name, at] = (len(inside) * starts.count((name, at)), sum(some) / len(some) if some else None)
        assert got.keys() == want.keys() and len(got) > 50
        for k, (n, mean) in want.items():
            assert got[k][0] == n and (got[k][1] == mean if mean is None else got[k][1] == pytest.approx(mean, abs=1e-9, nan_ok=True)), k
    assert max(scanned) <= 2 * len(s) + 4 * len(starts)
    assert runs.idle_power(ds, dq, 0.0).count() == runs.idle_power(ds.limit(0), dq).count() == runs.idle_power(ds, dq.limit(0)).count() == 0


def test_full_report_in_rounds(spark, monkeypatch):
    """Base sent in several rounds, and queries met a few at a time, give the report of all pairs at once."""
    v = np.random.default_rng(12).standard_normal((300, 16))
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    ref, test = unit(v), unit(np.round(v, 1))
    monkeypatch.setattr(nearest, "HELD", 70 * 16 * 8)
    monkeypatch.setattr(nearest, "ROWS", 50)
    told = validate.full_accuracy_report(*(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>") for m in (ref, test)), (1, 5)).first()
    order = [np.argsort(-(m @ m.T) + 9 * np.eye(300), axis=1, kind="stable") for m in (ref, test)]
    for k in (1, 5):
        assert told[f"top_{k}"] == pytest.approx(np.mean([order[0][i, 0] in order[1][i, :k] for i in range(300)]))
    assert told.n == 300 and told.max_abs == pytest.approx(np.abs(ref - test).max())


def test_margins_hold_few_queries_at_a_time(spark, monkeypatch):
    """No step takes more than ROWS queries of a batch at once, whatever they visit, and the margins are those of all pairs."""
    v = np.random.default_rng(13).standard_normal((400, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    monkeypatch.setattr(nearest, "ROWS", 32)
    seen = spark.sparkContext.accumulator(0)
    real = nearest._bound

    def bounded(rows, *rest):
        seen.add(int(len(rows) > 32))
        return real(rows, *rest)

    monkeypatch.setattr(nearest, "_bound", bounded)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    real_top = nearest.all_pairs_top
    monkeypatch.setattr(validate, "all_pairs_top", lambda a, b, k: real_top(a, b, k, block=64))
    told = validate.margins(df).first()
    top = -np.sort(-(v @ v.T) + 9 * np.eye(400), axis=1)
    m = top[:, 0] - top[:, 1]
    assert told.n == 400 and (told.mean, told.median, told.least) == pytest.approx((m.mean(), np.median(m), m.min())) and seen.value == 0


def test_sample_and_split(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert grid.sample(df, "k", 5, 1).count() == 5 and grid.sample(df, "k", 9, 1).count() == 5
    three = sorted(r.k for r in grid.sample(df, "k", 3, 1).collect())
    assert len(three) == 3 and three == sorted(r.k for r in grid.sample(df.repartition(4), "k", 3, 1).collect())
    assert [r.split for r in grid.split(df, "k", 2, 1).orderBy("k").collect()] == ["calibration"] * 2 + ["validation"] + ["rest"] * 2


@pytest.mark.parametrize("seed", range(4))
def test_busy_union(spark, seed):
    rng = random.Random(seed)
    spans = [("g", float(a), float(a + rng.randint(0, 9))) for a in (rng.randint(0, 60) for _ in range(25))] + [("g", 5.0, 5.0), ("g", 60.0, 90.0), ("h", 1.0, 2.0), ("h", 2.0, 3.0), ("h", 2.5, 2.75)]
    got = {r.g: r for r in runs.busy(spark.createDataFrame(spans, "g string, start double, stop double"), ["g"], F.lit(10.0), F.lit(70.0)).collect()}
    on = {t for g, a, b in spans if g == "g" for t in range(10, 70) if a <= t < b}
    assert got["g"].busy == len(on) and "h" not in got
    assert runs.busy(spark.createDataFrame(spans, "g string, start double, stop double").where("g = 'h'"), ["g"], F.lit(0.0), F.lit(9.0)).first().busy == 2


def test_phase_ends_and_empty_phase(spark):
    s = spark.createDataFrame([(1.0, 10.0, 1.0), (0.9, 99.0, 1.0), (9.0, 20.0, 3.0), (9.1, 99.0, 1.0), (25.0, 4.0, 0.0)], "s double, power double, util double")
    ph = spark.createDataFrame([("load", 0.0, 10.0, 5), ("idle", 20.0, 30.0, 1)], "name string, start double, stop double, n_items int")
    r = runs.energy(s, ph).first()
    assert (r.n_samples, r.mean_power, r.max_power, r.joules, r.joules_above_idle) == (2, 15.0, 20.0, 30.0, 22.0)
    with pytest.raises(Exception, match="no samples"):
        runs.energy(s, ph.unionByName(spark.createDataFrame([("load", 100.0, 110.0, 1)], ph.schema))).collect()
    assert runs.sampled_in(s, ph, -1.0, -1.0).where("name = 'load'").count() == 4


def test_sum_of_medians_is_not_median_of_sums(spark):
    t = spark.createDataFrame([("x", st, rep, float(ms)) for st, ms3 in (("a", (1, 5, 9)), ("b", (9, 1, 5)), ("c", (5, 9, 2))) for rep, ms in enumerate(ms3)], "config string, stage string, rep int, ms double")
    a, b = runs.sum_of_medians(t, ["config"], ["c"]).first(), runs.median_of_sums(t, ["config"]).first()
    assert (a.with_io, a.without_io, b.median) == (15.0, 10.0, 15.0) or a.with_io != b.median


def test_gates_and_ties(spark):
    none = spark.createDataFrame([], "id int")
    m = spark.createDataFrame([(1, 0.001), (2, None)], "id int, margin double")
    assert validate.near_ties(none, m, 0.0032).first().all_near
    r = validate.near_ties(spark.createDataFrame([(1,), (2,)], "id int"), m, 0.0032).first()
    assert (r.n, r.n_near, r.all_near) == (2, 1, False)
    rows = spark.createDataFrame([(1.0, 2.0, "raw", "cached")], "a double, b double, x string, y string")
    with pytest.raises(Exception, match="boundary"):
        validate.guarded_ratio(rows, "a", "b", "x", "y").collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b+c",)], "n string")
    assert df.select(text.tag(F.col("n"))).first()[0] == "a_b_c"
    with pytest.raises(Exception, match="no rule"):
        df.select(text.classify(F.col("n"), [("prefix", "x", "g")])).collect()
    r = spark.createDataFrame([("921.5", "256.7"), ("10", "3"), ("3", "1"), ("1", "0")], "a string, b string").select(text.lower_bound_ratio(F.col("a"), F.col("b")).cast("string")).collect()
    assert [x[0] for x in r] == ["3.58", "3.33", "3.00", None]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert zero.select(vectors.l2_normalized(F.col("v"))).first()[0] == [0.0, 0.0]


def test_projection(spark):
    """Known points: the central meridian at the equator, and a forward series checked by inversion."""
    with pytest.raises(ValueError):
        projection.checked_crs("EPSG:1", "EPSG:4326", ("EPSG:32651", "EPSG:4326"))

    def forward(lon, lat, zone):
        f = 1 / projection.INVERSE_FLATTENING
        n, e = f / (2 - f), math.sqrt(f * (2 - f))
        radius, _ = projection._series(n)
        alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4 - 127 / 288 * n**5, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4 + 281 / 630 * n**5, 61 / 240 * n**3 - 103 / 140 * n**4 + 15061 / 26880 * n**5, 49561 / 161280 * n**4 - 179 / 168 * n**5, 34729 / 80640 * n**5]
        phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
        t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
        xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
        x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
        y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
        return 500000 + projection.K0 * radius * x, projection.K0 * radius * y

    places = [(123.0, 0.0), (121.5, 31.2), (125.9, 59.0), (120.1, 1.0), (123.0, 80.0)]
    df = spark.createDataFrame([forward(*p, 51) for p in places], "e double, n double")
    got = df.select(*projection.utm_to_lonlat(F.col("e"), F.col("n"), 51)).collect()
    assert np.allclose([tuple(g) for g in got], places, atol=1e-9)


def test_equality_compares_digests(spark):
    """Nulls within arrays, NaN, signed zeros, nested values, missing and repeated keys; wide columns don't cross the shuffle."""
    schema = "k int, a array<double>, s struct<x:int,y:array<string>>, n double"
    one = [(1, [1.0, None], (1, ["p"]), 0.0), (2, [None, 1.0], (None, None), math.nan), (3, None, None, 1.0), (4, [], (1, ["p"]), 2.0), (5, [1.0], (2, []), None), (None, [1.0], None, 1.0), (7, [1.0], None, 1.0), (7, [2.0], None, 1.0)]
    two = [(1, [None, 1.0], (1, ["p"]), -0.0), (2, [None, 1.0], (None, None), math.nan), (3, [], (None, None), 1.5), (4, [], (1, ["q"]), 2.0), (5, [1.0], (2, []), None), (None, [1.0], None, 1.0), (7, [1.0], None, 1.0), (8, None, None, None)]
    a, b = (spark.createDataFrame(x, schema) for x in (one, two))
    columns = ["a", "s", "n"]
    left = a.select("k", *(F.col(c).alias(f"x{c}") for c in columns), F.lit(1).alias("ina"))
    right = b.select("k", *(F.col(c).alias(f"y{c}") for c in columns), F.lit(1).alias("inb"))
    pairs = left.join(right, "k", "full")
    there = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    want = {c: (pairs.where(there).count(), pairs.where(~there).count(), pairs.where(there & ~F.col(f"x{c}").eqNullSafe(F.col(f"y{c}"))).count()) for c in columns}
    got = {r.name: (r.n_both, r.n_missing, r.n_differing) for r in validate.equality(a, b, ["k"], columns).collect()}
    assert got == want and want["a"][2] == 3 and want["n"][2] == 1
    same = {r.name: r.equal for r in validate.equality(a.where("k < 6"), a.where("k < 6"), ["k"], columns).collect()}
    assert same == dict.fromkeys(columns, True)
    assert not any(r.n_both or r.n_missing for r in validate.equality(a.limit(0), b.limit(0), ["k"], columns).collect())


def test_variant_report_leaves_out_what_is_not_finite(spark):
    """Two scenes, points without a match, a NaN spectrum: each statistic over what is there."""
    kind = "struct<row:int,col:int,cosine:double,displacement:double,score:double>"
    hit = lambda r, c, k, d: (r, c, k, d, k)
    found = spark.createDataFrame([("a", 1, hit(0, 0, 0.5, 1.0)), ("a", 2, None), ("a", 3, hit(0, 1, math.nan, 3.0)), ("b", 1, hit(0, 0, 0.9, 2.0)), ("b", 9, None)], f"scene string, id int, x {kind}")
    base = spark.createDataFrame([("a", 1, hit(0, 0, 0.4, 4.0)), ("a", 2, None), ("a", 3, None), ("b", 1, hit(0, 1, 0.9, math.inf))], f"scene string, id int, x {kind}")
    pixels = spark.createDataFrame([("a", 0, 0, [1.0, 5.0]), ("a", 0, 1, [math.nan, 1.0]), ("b", 0, 0, [7.0, 0.0])], "scene string, row int, col int, spectrum array<double>")
    truth = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("a", 2, [0.0, 0.0]), ("a", 3, [1.0, 1.0]), ("b", 1, [0.0, 0.0])], "scene string, id int, spectrum array<double>")
    r = match.variant_report(found, base, ["x"], pixels, truth).collect()
    assert len(r) == 1 and (r[0].variant, r[0].n, r[0].n_none, r[0].agreement) == ("x", 4, 1, 0.5)
    assert (r[0].displacement_mean, r[0].displacement_gap, r[0].cosine_mean) == (2.0, 3.0, 0.7)
    assert (r[0].error_mean, r[0].error_median) == (5.0, 5.0)
    none = match.variant_report(found.where("x is null"), base, ["x"], pixels, truth).first()
    assert (none.n, none.n_none, none.agreement, none.cosine_mean, none.error_median) == (1, 1, 1.0, None, None)
