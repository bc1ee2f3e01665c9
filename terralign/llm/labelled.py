"""Bounded samples of labelled documents, and the hold-out rule, for the classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, allowed: Column, limits: dict[int, int]) -> DataFrame:
    """Labelled whole texts (y, _text): for each class at most limits[y] documents, those of least hash of the key.

    allowed tells which rows of labels may be used. Of several labels for a key the
    highest counts, and of several texts the least; null labels and keys are left
    out. The bound on the sample is the sum of limits, however often a row is
    repeated, so its keys can be broadcast.
    """
    known = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("y"))
    ids = reduce(DataFrame.unionAll, (known.where(F.col("y") == y).orderBy(F.xxhash64("_key"), "_key").limit(n) for y, n in limits.items()))
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(ids), "_key").groupBy("_key").agg(F.min("y").alias("y"), F.min("_text").alias("_text")).select("y", "_text")
