"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralign.llm.common import ranked, written


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key (Lamping and Veach 2014): a key leaves its shard only for a new one."""
    key, shard, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        shard[todo] = ahead[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[todo] = ((shard[todo] + 1) * (float(1 << 31) / ((key[todo] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        todo = todo[ahead[todo] < shards]
    return shard


def hashed(key: Column) -> Column:
    """MD5 of a key as text, so that 7 has one shard whatever its type; zeros for a null key."""
    return F.coalesce(F.md5(key.cast("string").cast("binary")), F.lit("0" * 32))


def shard_of(digest: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a digest of hashed(), by its first 64 bits."""

    @F.pandas_udf("int")
    def pick(digests: pd.Series) -> pd.Series:
        first = np.frombuffer(bytes.fromhex("".join(digests.str[:16])), ">u8")
        return pd.Series(jump(first, shards).astype(np.int32))

    return pick(digest)


def sharded(df: DataFrame, key: str, shards: int = 16, carry: dict[str, Column] | None = None) -> DataFrame:
    """Rows dealt to shards by key: key, the carried columns, shard, grown_shard (with one shard more), slot.

    Only key (as text) and shard count decide, so rows with equal keys share a shard,
    and growing from shards to shards + 1 moves rows into the new shard alone. slot
    counts from 0 in each shard without gaps, in order of the keys' digests and what
    is carried. A null key is a key like any other; equal rows each get a slot; an
    empty table gives no rows; extra columns of df are ignored unless carried. What
    is carried should be small: it is shuffled.
    """
    carry = carry or {}
    rows = df.select(F.col(key).alias("_key"), hashed(F.col(key)).alias("_d"), *(c.alias(n) for n, c in carry.items()))
    rows = rows.select("*", shard_of(F.col("_d"), shards).alias("shard"), shard_of(F.col("_d"), shards + 1).alias("grown_shard"))
    bucket = F.conv(F.substring("_d", 1, 2), 16, 10).cast("int")  # of the order's own beginning
    out = ranked(written(rows), ["shard"], ["_d", *carry], "slot", bucket)
    return out.select(F.col("_key").alias(key), *carry, "shard", "grown_shard", "slot")


#: The same rows in DuckDB's SQL: MD5, jump hashing by recursion, and CRC-32 byte by byte with a table made from its rule.
ORACLE = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(md5(CAST(doc_id AS VARCHAR)), repeat('0', 32)) AS h FROM documents),
steps AS (SELECT h, n, CAST(k AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j
FROM (SELECT DISTINCT h, CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS k FROM d), (VALUES (16), (17)) AS t(n)
UNION ALL SELECT h, n, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
FROM (SELECT h, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM steps WHERE j < n)),
dealt AS (SELECT h, max(b) FILTER (n = 16) AS shard, max(b) FILTER (n = 17) AS grown FROM steps GROUP BY h),
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
hexed AS (SELECT *, hex(encode(text)) AS x FROM d),
split AS (SELECT *, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM hexed),
summed AS (SELECT doc_id, h, CAST(length(x) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM split, crc)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
CAST(row_number() OVER (PARTITION BY shard ORDER BY h, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM summed JOIN dealt USING (h)"""


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents into 16 shards by doc_id; text null counts no bytes and the checksum of an empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", 16, {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
