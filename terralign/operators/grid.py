"""Per-band statistics, standardizing and patches of a raster: one row per pixel (scene, row, col, spectrum)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from terralign.contract import Contract
from terralign.functions.raster import valid_pixel
from terralign.operators.tiles import dense, tiled


def band_stats(raster: DataFrame) -> DataFrame:
    """Mean and population deviation of each band over all pixels, invalid ones too: scene, band, mean, std."""
    long = raster.select("scene", F.posexplode("spectrum").alias("band", "x"))
    return long.groupBy("scene", "band").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def _packed_stats(raster: DataFrame) -> DataFrame:
    """One row per scene: the statistics as arrays in band order."""
    told = band_stats(raster).groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("band", "mean", "std"))).alias("s"))
    return told.select("scene", F.col("s.mean").alias("_mean"), F.col("s.std").alias("_std"))


def standardized(raster: DataFrame) -> DataFrame:
    """raster with spectrum as z-scores, (x - mean) / (std + 1e-8) by band of its scene."""
    stats = _packed_stats(raster)  # a row per scene: Spark broadcasts it while that is small
    z = F.transform("spectrum", lambda x, i: (x.cast("double") - F.get("_mean", i)) / (F.get("_std", i) + 1e-8))
    return raster.join(stats, "scene").withColumn("spectrum", z).drop("_mean", "_std")


def masked(raster: DataFrame, contract: Contract) -> DataFrame:
    return raster.where(valid_pixel(F.col("spectrum"), contract))


def patches(raster: DataFrame, centres: DataFrame, bands: int, size: int = 3, side: int = 32) -> DataFrame:
    """Square patches around pixels (scene, row, col): patch, flat in (band, row, column) order, 0 outside the grid.

    raster (one row per pixel) should be standardized first, so that what is filled in
    is the band mean. Pixels and centres meet in tiles of side pixels: a centre goes to
    its own tile and a pixel also to the tiles that it borders on, so a spectrum is moved
    once and (2 size / side of them) again. A tile becomes one dense block, of which the
    patches are windows. Null spectra and bands count as 0. Repeated centres give one
    patch; a centre of whose patch no pixel exists, or with a null place, gives none.
    """
    if size % 2 == 0:
        raise ValueError("a patch has an odd size")
    h = size // 2
    schema = StructType([*(StructField(c, centres.schema[c].dataType) for c in ("scene", "row", "col")), StructField("patch", ArrayType(DoubleType()))])

    def cut(key: tuple, pixels: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([wanted.column(c).slice(0, 0) for c in ("scene", "row", "col")] + [pa.array([], pa.list_(pa.float64()))], names=schema.names)
        if not pixels.num_rows or not wanted.num_rows:
            return empty
        top, left = key[1].as_py() * side - h, key[2].as_py() * side - h
        block, there = np.zeros((side + 2 * h, side + 2 * h, bands)), np.zeros((side + 2 * h, side + 2 * h), bool)
        r, c = (pixels.column(n).to_numpy() - o for n, o in (("row", top), ("col", left)))
        there[r, c] = True
        block[r, c] = dense(pixels.column("spectrum"), bands, 0.0)
        own = wanted.group_by(["scene", "row", "col"], use_threads=False).aggregate([])
        at = tuple(own.column(n).to_numpy() - o - h for n, o in (("row", top), ("col", left)))
        seen = np.flatnonzero(sliding_window_view(there, (size, size))[at].any(axis=(1, 2)))
        flat = sliding_window_view(block, (size, size), axis=(0, 1))[at[0][seen], at[1][seen]].reshape(len(seen), -1)
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        own = own.take(pa.array(seen))
        return pa.Table.from_arrays([*(own.column(c) for c in ("scene", "row", "col")), made], names=schema.names)

    pixels = tiled(raster.select("scene", "row", "col", "spectrum"), side, h)
    wanted = tiled(centres.select("scene", "row", "col"), side, 0)
    wanted = wanted.toDF(*wanted.columns)  # columns of its own, where both come from one raster
    return pixels.groupBy("scene", "_tr", "_tc").cogroup(wanted.groupBy("scene", "_tr", "_tc")).applyInArrow(cut, schema)


def standardized_patches(raster: DataFrame, contract: Contract, bands: int) -> DataFrame:
    """Mask, standardize and gather in one plan: patches of every valid pixel."""
    return patches(standardized(raster), masked(raster, contract), bands, contract.patch)


def eligible(points: DataFrame, valid: DataFrame) -> DataFrame:
    """Points (scene, row, col, ...) on a valid pixel."""
    return points.join(valid.select("scene", "row", "col").distinct(), ["scene", "row", "col"], "left_semi")


def covered(points: DataFrame, valid: DataFrame, radius: int) -> DataFrame:
    """Distinct valid pixels within the window of any point, by way of tiles of the window's size."""
    side = 2 * radius + 1
    near = points.select("scene", F.col("row").alias("pr"), F.col("col").alias("pc")).distinct()
    tile = lambda c, d: F.floor((F.col(c) + d) / side)
    spread = near.withColumn("tr", F.explode(F.sequence(tile("pr", -radius), tile("pr", radius)))).withColumn("tc", F.explode(F.sequence(tile("pc", -radius), tile("pc", radius))))
    cells = valid.select("scene", "row", "col").withColumn("tr", tile("row", 0)).withColumn("tc", tile("col", 0))
    inside = (F.abs(spread["pr"] - cells["row"]) <= radius) & (F.abs(spread["pc"] - cells["col"]) <= radius)
    return cells.join(spread, (cells["scene"] == spread["scene"]) & (cells["tr"] == spread["tr"]) & (cells["tc"] == spread["tc"]) & inside, "left_semi").select("scene", "row", "col").distinct()


def sample(points: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by least md5 of seed and key, all if there are no more; one top-n per partition, no full sort."""
    return points.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def split(samples: DataFrame, key: str, calibration: int, validation: int) -> DataFrame:
    """samples with split: 'calibration' for the first, 'validation' for the next, else 'rest', in order of key."""
    first = samples.select(F.col(key).alias("_k")).orderBy("_k").limit(calibration + validation)
    placed = first.withColumn("_n", F.row_number().over(W.orderBy("_k")))  # at most calibration + validation rows
    name = F.when(F.col("_n").isNull(), "rest").when(F.col("_n") <= calibration, "calibration").otherwise("validation")
    return samples.join(placed, samples[key] == placed["_k"], "left").withColumn("split", name).drop("_k", "_n")


def pixel_index(valid: DataFrame) -> DataFrame:
    """valid (scene, row, col, ...) with idx: a compact row-major index from 0 within each scene.

    By way of each row's count, so no scene is sorted as a whole: what is gathered
    by scene is one number a row.
    """
    before = W.partitionBy("scene").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    starts = valid.groupBy("scene", "row").agg(F.count("*").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy("scene", "row").orderBy("col"))
    return valid.withColumn("_k", place).join(starts, ["scene", "row"]).withColumn("idx", F.col("_at") + F.col("_k") - 1).drop("_k", "_at")
