"""Joins on keys of which some may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that looked_up() broadcasts at most.
HOT = 4096


def looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, least: int = 1000) -> DataFrame:
    """df (a stored table, or cheap to read twice) left-joined with table, whose keys are unique and whose column weight counts the rows of df that have them.

    Keys that hold more than one in HOT of all counted rows (fewer than HOT of them,
    whatever the data) and more than least are broadcast, so that their rows stay
    where they are; the others meet by shuffle. Rows with a null key find nothing.
    """
    keys = list(keys)
    bound = max((table.agg(F.sum(weight)).first()[0] or 0) // HOT, least)
    hot = table.where(F.col(weight) > bound)
    if hot.isEmpty():
        return df.join(table, keys, "left")
    rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return df.join(F.broadcast(hot), keys).unionByName(rest.join(table.where(F.col(weight) <= bound), keys, "left"))
