"""Inference over vectors by an encoder that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Makes an encoder: called once a task, so that a model is loaded there. The encoder maps float32 (n, size) to (n, width).
Factory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def encode(df: DataFrame, column: str, factory: Factory, batch: int = 2048, out: str = "feature") -> DataFrame:
    """df with out, the encoder's vectors of an array column; null arrays stay null. Filter first: no filter moves below this.

    Arrays of another length than the first of a task raise.
    """
    at = df.columns.index(column)
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).schema

    def run(batches):
        encoder = factory()
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                have = [x is not None for x in part.column(at).to_pylist()]
                made: list = [None] * part.num_rows
                if any(have):
                    x = np.array([v for v in part.column(at).to_pylist() if v is not None], np.float32)
                    y = iter(encoder(x).astype(np.float32))
                    made = [next(y) if h else None for h in have]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.float32()))], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def checked(df: DataFrame, column: str, kind: str, size: int) -> DataFrame:
    """df, once column is of the type and each array of the size that an encoder takes; else an error."""
    if df.schema[column].dataType.simpleString() != kind:
        raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}, expected {kind}")
    ok = F.col(column).isNull() | (F.size(column) == size)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit(f"{column} must have {size} elements")).cast(kind)))
