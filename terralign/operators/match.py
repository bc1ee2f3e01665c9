"""Best pixel within a search window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from terralign.functions.vectors import is_finite, max_abs_difference
from terralign.operators.lineage import cut
from terralign.operators.quantiles import quantiles
from terralign.operators.tiles import dense, tiled

#: From cosine and distance to a score. Plain arithmetic serves columns and arrays alike, and arrays are faster.
Score = Callable

#: Pixels of a tile's side.
SIDE = 64


def cosine_score(cosine, distance):
    return cosine


def penalized_score(weight: float, radius: int) -> Score:
    """Our own example of a spatial penalty: cosine less weight x distance / radius."""
    return lambda cosine, distance: cosine - weight * distance / float(radius)


def _takes_arrays(score: Score) -> bool:
    try:
        return isinstance(score(np.ones(2), np.ones(2)), np.ndarray)
    except Exception:  # whatever a function of columns makes of arrays
        return False


def candidates(points: DataFrame, pixels: DataFrame, radius: int, own: bool = True) -> DataFrame:
    """Pairs of a point (id, scene, row, col, v) and a pixel (scene, row, col, v) of its window, v normalized: scene, id, row, col, cosine, distance.

    The window is the square of radius pixels each way, cut at the grid; without own,
    the point's own pixel is left out. Both sides meet in tiles of the window's size, so
    a point is sent to at most four tiles instead of to each of its (2 radius + 1)^2
    pixels. For scores of columns, and for whoever wants the pairs.
    """
    side = 2 * radius + 1
    p = tiled(points.select("id", "scene", "row", "col", F.col("v").alias("pv")), side, radius).withColumnsRenamed({"row": "pr", "col": "pc"})
    q = tiled(pixels.select("scene", "row", "col", "v"), side, 0)
    inside = (F.abs(F.col("pr") - F.col("row")) <= radius) & (F.abs(F.col("pc") - F.col("col")) <= radius)
    if not own:
        inside = inside & ((F.col("pr") != F.col("row")) | (F.col("pc") != F.col("col")))
    met = p.join(q, ["scene", "_tr", "_tc"]).where(inside)
    cosine = F.aggregate(F.zip_with("pv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    distance = F.sqrt(((F.col("row") - F.col("pr")) ** 2 + (F.col("col") - F.col("pc")) ** 2).cast("double"))
    return met.select("scene", "id", "row", "col", cosine.alias("cosine"), distance.alias("distance"))


def _in_tiles(points: DataFrame, pixels: DataFrame, radius: int, own: bool, shown: dict[str, str], start: Callable, see: Callable, end: Callable) -> DataFrame:
    """id, scene and the columns shown (name to type) of every point, from its tile alone.

    A point goes to its own tile, a pixel also to those within radius. There the
    pixels of one offset from all points are taken at a time, in row-major order: see(state,
    places of points, row, col, cosine, distance) updates what start(n) made for
    n points, and end(state) gives the columns. Sums run along the bands in
    order, so that equal vectors have equal cosines.
    """
    side = max(SIDE, 2 * radius)
    schema = StructType([StructField("id", points.schema["id"].dataType), StructField("scene", points.schema["scene"].dataType), *(StructField(n, _parse_datatype_string(t)) for n, t in shown.items())])
    offsets = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if own or r or c]

    def matched(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        made = []
        if theirs.num_rows:
            top, left = key[1].as_py() * side - radius, key[2].as_py() * side - radius
            place = np.full((side + 2 * radius, side + 2 * radius), -1)
            row, col = (theirs.column(c).to_numpy() for c in ("row", "col"))
            place[row - top, col - left] = np.arange(len(row))
            bands = max(1, *(pc.max(pc.list_value_length(t.column("v"))).as_py() or 0 for t in (mine, theirs)))
            seen = np.ascontiguousarray(dense(theirs.column("v"), bands, np.nan).T)
        for lo in range(0, mine.num_rows, 1024):
            part = mine.slice(lo, 1024)
            state = start(part.num_rows)
            if theirs.num_rows:
                v = np.ascontiguousarray(dense(part.column("v"), bands, np.nan).T)
                at, along = (part.column(c).to_numpy() for c in ("row", "col"))
                for dr, dc in offsets:
                    other = place[at + dr - top, along + dc - left]
                    have = np.flatnonzero(other >= 0)
                    if len(have):
                        products = v[:, have] * seen[:, other[have]]
                        cosine = products.sum(axis=0) if len(have) > 1 else np.cumsum(products[:, 0])[-1:]
                        see(state, have, row[other[have]], col[other[have]], cosine, np.full(len(have), np.sqrt(float(dr * dr + dc * dc))))
            made.append(pa.Table.from_arrays([part.column("id"), part.column("scene"), *end(state)], names=schema.names))
        names = [mine.column("id").slice(0, 0), mine.column("scene").slice(0, 0), *end(start(0))]
        return pa.concat_tables(made) if made else pa.Table.from_arrays(names, names=schema.names)

    p = tiled(points.select("id", "scene", "row", "col", "v"), side, 0)
    q = tiled(pixels.select("scene", "row", "col", "v"), side, radius)
    q = q.toDF(*q.columns)  # columns of its own, where both come from one raster
    told = p.groupBy("scene", "_tr", "_tc").cogroup(q.groupBy("scene", "_tr", "_tc")).applyInArrow(matched, schema)
    lost = points.where("scene is null or row is null or col is null").select("id", "scene", *(F.lit(None).cast(t).alias(n) for n, t in shown.items()))
    return told.unionByName(lost)


def window_match(points: DataFrame, pixels: DataFrame, radius: int, scores: dict[str, Score], own: bool = True) -> DataFrame:
    """For each point and each named score the best pixel: id, scene, and a struct (row, col, cosine, displacement, score) of that name.

    Of equal scores the first in row-major order wins; scores that aren't finite
    don't count (so no null, NaN or shorter vector matches); the struct is null where
    no candidate is left. All scores share the candidates. Scores that work on arrays
    are computed tile by tile (see _in_tiles); others as columns, by way of candidates(),
    where a maximum of structs keeps one row per point and task.
    """
    if all(_takes_arrays(s) for s in scores.values()):
        kind = "struct<row:int,col:int,cosine:double,displacement:double,score:double>"
        kinds = [("row", pa.int32()), ("col", pa.int32()), ("cosine", pa.float64()), ("displacement", pa.float64()), ("score", pa.float64())]

        def start(n: int) -> dict:
            return {name: {f: np.full(n, -np.inf) if f == "score" else np.zeros(n, t.to_pandas_dtype()) for f, t in kinds} for name in scores}

        def see(state: dict, at: np.ndarray, row: np.ndarray, col: np.ndarray, cosine: np.ndarray, distance: np.ndarray) -> None:
            for name, score in scores.items():
                s, best = score(cosine, distance), state[name]
                better = np.isfinite(s) & (s > best["score"][at])
                for f, x in zip(("row", "col", "cosine", "displacement", "score"), (row, col, cosine, distance, s), strict=True):
                    best[f][at[better]] = x[better]

        def end(state: dict) -> list[pa.Array]:
            return [pa.StructArray.from_arrays([pa.array(b[f], t) for f, t in kinds], fields=[pa.field(f, t) for f, t in kinds], mask=pa.array(np.isneginf(b["score"]))) for b in state.values()]

        return _in_tiles(points, pixels, radius, own, dict.fromkeys(scores, kind), start, see, end)
    made = candidates(points, pixels, radius, own)
    best = []
    for name, score in scores.items():
        s = score(F.col("cosine"), F.col("distance"))
        best.append(F.max(F.when(is_finite(s), F.struct(s.alias("s"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), F.col("cosine").alias("k"), F.col("distance").alias("d")))).alias(name))
    told = points.select("id", "scene").join(made.groupBy("scene", "id").agg(*best), ["scene", "id"], "left")
    shown = [F.when(F.col(n).isNotNull(), F.struct((-F.col(n)["r"]).alias("row"), (-F.col(n)["c"]).alias("col"), F.col(n)["k"].alias("cosine"), F.col(n)["d"].alias("displacement"), F.col(n)["s"].alias("score"))).alias(n) for n in scores]
    return told.select("id", "scene", *shown)


def match_margin(points: DataFrame, pixels: DataFrame, radius: int, score: Score = cosine_score, own: bool = True) -> DataFrame:
    """id, scene, best and second finite score and their margin, null with fewer than two candidates. score works on arrays."""

    def start(n: int) -> np.ndarray:
        return np.full((2, n), -np.inf)

    def see(top: np.ndarray, at: np.ndarray, row: np.ndarray, col: np.ndarray, cosine: np.ndarray, distance: np.ndarray) -> None:
        s = score(cosine, distance)
        s = np.where(np.isfinite(s), s, -np.inf)
        top[1, at] = np.maximum(top[1, at], np.minimum(top[0, at], s))
        top[0, at] = np.maximum(top[0, at], s)

    def end(top: np.ndarray) -> list[pa.Array]:
        one, two = (pa.array(x, pa.float64(), mask=np.isneginf(x)) for x in top)
        return [one, two, pc.subtract(one, two)]

    return _in_tiles(points, pixels, radius, own, dict.fromkeys(("top1", "top2", "margin"), "double"), start, see, end)


def differing(found: DataFrame, a: str, b: str) -> Column:
    """Whether two named scores of window_match() chose different pixels; null where either chose none."""
    return (F.col(f"{a}.row") != F.col(f"{b}.row")) | (F.col(f"{a}.col") != F.col(f"{b}.col"))


def agreement(found: DataFrame, a: str, b: str) -> DataFrame:
    """Of window_match() with two scores: n, the share of points with the same pixel, and mean and median of a's displacement less b's where both are finite."""
    rows = found.select((~differing(found, a, b)).cast("int").alias("same"), (F.col(f"{a}.displacement") - F.col(f"{b}.displacement")).alias("gap"))
    rows = cut(rows)  # matched once, not for each pass over the gaps
    gaps = quantiles(rows, [], "gap", {"median_gap": 0.5}, {"n": F.count("*"), "agreement": F.avg("same"), "mean_gap": F.avg("gap")})
    return gaps.select("n", "agreement", "mean_gap", "median_gap")


def spectrum_errors(found: DataFrame, name: str, pixels: DataFrame, truth: DataFrame) -> DataFrame:
    """id, scene and error: the largest difference between a point's own spectrum (truth: scene, id, spectrum) and that of the pixel (scene, row, col, spectrum) chosen for it."""
    chosen = found.select("id", "scene", F.col(f"{name}.row").alias("row"), F.col(f"{name}.col").alias("col")).where("row is not null")
    own = chosen.join(truth.select("scene", "id", F.col("spectrum").alias("_truth")), ["scene", "id"])
    return own.join(pixels.select("scene", "row", "col", "spectrum"), ["scene", "row", "col"]).select("id", "scene", max_abs_difference(F.col("_truth"), F.col("spectrum")).alias("error"))


def variant_report(found: DataFrame, base: DataFrame, names: Sequence[str], pixels: DataFrame, truth: DataFrame) -> DataFrame:
    """A run of window_match() against another, a row for each named score (variant), over the points (scene, id) of both.

    n points, n_none without a match in found, agreement (share with the same pixel, none
    being a pixel like any other), means of displacement and cosine, displacement_gap (mean of
    the absolute difference to base's), and mean and median of the errors of chosen
    spectra (see spectrum_errors). What isn't finite, or not there, is left out of a
    statistic; one of nothing is null.
    """
    both = found.select("scene", "id", *names).join(base.select("scene", "id", *(F.col(n).alias(f"_base_{n}") for n in names)), ["scene", "id"])
    sides = F.array(*(F.struct(F.lit(n).alias("variant"), F.col(n).alias("a"), F.col(f"_base_{n}").alias("b")) for n in names))
    each = cut(both.select("scene", "id", F.explode(sides).alias("s")).select("scene", "id", "s.*"))
    chosen = each.where("a is not null").select("scene", "id", "variant", F.col("a.row").alias("row"), F.col("a.col").alias("col"))
    own = chosen.join(truth.select("scene", "id", F.col("spectrum").alias("_truth")), ["scene", "id"])
    errors = own.join(pixels.select("scene", "row", "col", "spectrum"), ["scene", "row", "col"]).select("scene", "id", "variant", max_abs_difference(F.col("_truth"), F.col("spectrum")).alias("error"))
    finite = lambda x: F.when(is_finite(x), x)
    told = each.join(errors, ["scene", "id", "variant"], "left").select(
        "variant", F.col("a").isNull().alias("none"), (F.col("a.row").eqNullSafe(F.col("b.row")) & F.col("a.col").eqNullSafe(F.col("b.col"))).cast("int").alias("same"),
        finite(F.col("a.displacement")).alias("moved"), finite(F.abs(F.col("a.displacement") - F.col("b.displacement"))).alias("gap"), finite(F.col("a.cosine")).alias("cosine"), finite(F.col("error")).alias("error"),
    )
    means = {"agreement": "same", "displacement_mean": "moved", "displacement_gap": "gap", "cosine_mean": "cosine", "error_mean": "error"}
    return quantiles(cut(told), ["variant"], "error", {"error_median": 0.5}, {"n": F.count("*"), "n_none": F.count_if("none"), **{n: F.avg(c) for n, c in means.items()}})
