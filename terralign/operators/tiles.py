"""Tiles of a grid, with a border of what lies next to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, side: int, halo: int) -> DataFrame:
    """rows (scene, row, col, ...) once for each tile of side that they lie in or within halo of: _tr, _tc. Rows with a null place are left out.

    With side of at least twice halo a row goes to four tiles at most, and
    (1 + 2 halo / side) ** 2 on average.
    """
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    whole = rows.where("scene is not null and row is not null and col is not null")
    return whole.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col"))


def dense(column: pa.ChunkedArray, width: int, missing: float) -> np.ndarray:
    """Arrays of numbers as the rows of a matrix of doubles; what is null, or not there, is missing, what is beyond width left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    if not lists.null_count and (sizes == width).all():
        return flat.cast(pa.float64()).fill_null(missing).to_numpy(zero_copy_only=False).reshape(len(lists), width)
    out = np.full((len(lists), width), missing)
    for i, x in enumerate(lists.to_pylist()):
        for j, v in enumerate((x or [])[:width]):
            out[i, j] = missing if v is None else v
    return out
