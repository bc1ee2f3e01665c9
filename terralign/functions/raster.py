"""Pixel predicates, indices and the affine map, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralign.contract import Contract
from terralign.functions.vectors import total


def ndvi(spectrum: Column, red: int, nir: int) -> Column:
    """(nir - red) / (nir + red), and 0 where the denominator is 1e-12 or less."""
    n, r = F.get(spectrum, nir).cast("double"), F.get(spectrum, red).cast("double")
    return F.when(F.abs(n + r) > 1e-12, (n - r) / (n + r)).otherwise(F.lit(0.0))


def valid_pixel(spectrum: Column, contract: Contract) -> Column:
    """Vegetation mask: index above its threshold and band sum above epsilon, both strictly."""
    return (ndvi(spectrum, contract.red, contract.nir) > contract.ndvi_threshold) & (total(spectrum) > contract.nodata_epsilon)


def checked_geotransform(gt: Sequence[float]) -> tuple[float, ...]:
    """Six finite coefficients with an invertible 2 x 2 part, else ValueError."""
    import math

    gt = tuple(float(g) for g in gt)
    if len(gt) != 6 or not all(map(math.isfinite, gt)):
        raise ValueError("a geotransform has six finite coefficients")
    if abs(gt[1] * gt[5] - gt[2] * gt[4]) < 1e-18:
        raise ValueError("the geotransform cannot be inverted")
    return gt


def geotransform_checked(gt: Column) -> Column:
    """The same check for an array column: the array, or an error when the row is read."""
    finite = F.forall(gt, lambda g: g.isNotNull() & ~F.isnan(g) & (F.abs(g) != float("inf")))
    ok = (F.size(gt) == 6) & finite & (F.abs(gt[1] * gt[5] - gt[2] * gt[4]) >= 1e-18)
    return F.when(F.coalesce(ok, F.lit(False)), gt).otherwise(F.raise_error(F.lit("bad geotransform")).cast("array<double>"))


def fractional_pixel(gt: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) of map coordinates by the inverse of the affine map."""
    g = checked_geotransform(gt)
    det = g[1] * g[5] - g[2] * g[4]
    dx, dy = x - g[0], y - g[3]
    return (dy * g[1] - dx * g[4]) / det, (dx * g[5] - dy * g[2]) / det


def pixel(gt: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds the coordinates: floor, also below 0. Coordinates that aren't finite raise."""
    bad = F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
    row, col = fractional_pixel(gt, F.when(bad, F.raise_error(F.lit("coordinates must be finite")).cast("double")).otherwise(x), y)
    return F.floor(row).cast("bigint"), F.floor(col).cast("bigint")


def in_bounds(row: Column, col: Column, rows: int | Column, cols: int | Column) -> Column:
    return (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
