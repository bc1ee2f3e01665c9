import zlib

import numpy as np
from pyspark.sql import functions as F

from terralign.llm import sharding


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_matches_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_rows_slots_and_growth(spark, tmp_path):
    rows = [(i % 300, "x" * (i % 7)) for i in range(1200)] + [(None, None), (7, ""), (7, "")] + [(5, "hot")] * 700
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.query(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 16)).all()
    assert got.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    want = sorted(((-1 if d is None else d), len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want


def test_the_type_of_the_key_does_not_matter(spark):
    rows = spark.range(200).selectExpr("id as l", "cast(id as int) as i", "cast(id as string) as s")
    by = [{str(r[0]): (r.shard, r.grown_shard) for r in sharding.sharded(rows, k).collect()} for k in ("l", "i", "s")]
    assert by[0] == by[1] == by[2] and len({x[0] for x in by[0].values()}) == 16


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.query(spark, str(tmp_path)).count() == 0
