import pathlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralign.llm import decontam, linededup, lm, packing, pii, quality, queries, search, sharding, simhash, substring, toxicity, trie

SF = "/root/testdata/sf0.001"


def test_embeddings_match_sql(spark, tmp_path):
    """The small tables hold no near copies, so some are added."""
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    near = base.where("vec_id % 9 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    near = near.select((F.col("vec_id") + 1000 * F.col("k")).alias("vec_id"), F.transform("embedding", lambda x, i: (x + 0.04 * F.sin(F.col("vec_id") + i * F.col("k"))).cast("float")).alias("embedding"), "label")
    base.unionByName(near).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute("SELECT vec_id, n_links, component_id, kept FROM (" + queries.ORACLES["op8_embeddings"] + ")").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op8_embeddings"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want and any(r[1] for r in got)


def against_sql(spark, name, folder, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM (" + queries.ORACLES[name] + ")").fetchall()
    order = lambda rows: sorted(rows, key=str)
    got = [tuple(r) for r in df.collect()]
    assert order(got) == order(want) and got
    return got


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_sharding"])
def test_documents_match_sql(spark, name):
    against_sql(spark, name, SF, "documents")


def test_line_dedup_matches_sql_on_planted_runs(spark, tmp_path):
    rng = random.Random(1)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30)))
    shared = [[line() for _ in range(6)] for _ in range(5)]
    docs = [(0, None), (1, ""), (2, "\n \n")]
    for d in range(3, 80):
        body = []
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(shared)
            body += [line(), *part[: rng.randint(1, 6)], rng.choice(["", "  ", line()])]
        docs.append((d, "\n".join(body)))
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert sum(r[3] > 0 for r in against_sql(spark, "op3_line_dedup", tmp_path, "documents")) > 20


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    query = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert query(spark, str(tmp_path)).count() == 0


def test_columns_with_private_names_pass_through(spark):
    """Every name that an operator uses for itself, as a column of the caller's."""
    source = "".join(p.read_text() for p in pathlib.Path(queries.__file__).parent.glob("*.py"))
    names = sorted({*re.findall(r'"(_[a-zA-Z]\w*)"', source), "words", "cls", "w", "s", "root", "fp", "component", "lines", "first", "last", "runs", "y", "score", "node"})
    names = [n for k, n in enumerate(names) if n.lower() not in {m.lower() for m in names[:k]}]
    long = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, "call 988-555-2485 or " + long), (3, long), (4, None)], "doc_id long, text string")
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    items = spark.createDataFrame([(9, "nothing of this is in any of the documents at all so they stay")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    made = {
        "line_dedup": linededup.deduped(docs),
        "near_dedup": simhash.representatives(docs),
        "substring": substring.deduped(docs),
        "decontamination": decontam.decontaminated(docs, items),
        "pii": pii.pseudonymized(docs, "k"),
        "quality": quality.filtered(docs, quality.trained(docs, labels, F.lit(True)), least=0.0),
    }
    for stage, df in made.items():
        rows = df.collect()
        assert len(rows) == (4 if stage != "near_dedup" else 2), stage
        assert all(r[n] == f"own {n}" for r in rows for n in names), stage
    assert simhash.near_duplicates(docs).count() == packing.packed(docs).count() == lm.scored(docs, F.lit(True)).count() == 4
    assert search.ranked(docs, docs.withColumnRenamed("doc_id", "item_id")).where("item_id = 2").count() == 3
    turns = docs.selectExpr("doc_id as conv_id", "doc_id as turn", "'user' as role", "*").drop("doc_id")
    assert trie.trie(trie.paths(turns)).count() == 5 - 1  # the root, and a node for each different text
    assert toxicity.scored(docs, toxicity.trained(docs, labels, F.lit(True))).count() == sharding.sharded(docs, "doc_id").count() == 4
    assert decontam.overlaps(docs, docs.select(F.col("doc_id").alias("item_id"), *docs.columns[1:])).count() == 9
