import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from terralign.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_paths(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: tuple(own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[: h[c]] + turns[h[c] :]) for c, turns in own.items()}


def plain_nodes(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        own = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * own + sum(saved[k] for k in kids[node])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def corpus(seed, convs=150):
    """Conversations of few different turns, so that they share beginnings; a third are equal; odd rows; negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in range(-30, convs):
        if rng.random() < 0.1:
            continue
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b  c", "", None, "d\te\nf", "é ü"])) for _ in range(n)]
        if c % 3 == 0:
            turns = [("user", "hot one"), ("assistant", "hot two")] * 2
        rows += [(c, None if k == 0 and c % 7 == 0 else k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(None, 1, "user", "no id"), (5000, 0, "user", "x"), (5000, 0, "user", "x")]  # ids without a base; a repeated row
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shards", [(1, 1), (1, 7), (2, 40), (3, 3)])
def test_nodes_match_brute_force(spark, monkeypatch, seed, shards):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = corpus(seed)
    made = trie.rebuilt(trie.paths(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    want = plain_nodes(plain_paths(rows))
    assert {r.conv_id: len(r.path) // trie.STEP for r in made.collect()} == {c: len(p) for c, p in plain_paths(rows).items()}
    got = trie.trie(made, shards).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_without_broadcast_of_the_skeleton(spark, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST", 0)
    rows = corpus(4)
    got = trie.trie(trie.rebuilt(trie.paths(spark.createDataFrame(rows, SCHEMA))), 9).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_nodes(plain_paths(rows))


def test_query_matches_sql(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, SCHEMA).withColumn("conv_id_", F.lit("other")).toPandas().astype({"turn": "Int64", "conv_id": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    for folder in (tmp_path, "/root/testdata/sf0.001"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
        want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLE})").fetchall()
        got = [tuple(r) for r in trie.query(spark, str(folder)).select(*COLUMNS).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 50


def test_a_long_conversation_and_equal_ones(spark):
    """Thousands of turns in one conversation; many equal conversations are dealt over shards and still make one chain of nodes."""
    long = [(1, k, "user", f"t{k}") for k in range(3000)]
    equal = [(c, k, "user", f"e{k}") for c in range(1001, 1400, 20) for k in range(8)]
    rows = long + equal
    got = trie.trie(trie.rebuilt(trie.paths(spark.createDataFrame(rows, SCHEMA))), 6).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain_nodes(plain_paths(rows))


def test_conversations_without_turns_belong_to_the_root(spark):
    least = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie.trie(trie.rebuilt(trie.paths(spark.createDataFrame([(least, 0, "user", "x")], SCHEMA)))).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [(least, 0, None, 1, 0, 1, 0, hashlib.sha256(str(least).encode()).hexdigest())]
