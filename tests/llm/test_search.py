import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """Every document scored for every item."""
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) & set(c))
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k])]
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "und", "É", "ñ2", "x_y", "don't", *(f"w{int(200 * rng.random() ** 3)}" for _ in range(6))])
    text = lambda m: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(m))
    docs = [(d, text(rng.choice([1, 3, 10, 10, 10, 40, 200]))) for d in range(n)]
    docs += [(900 + d, docs[7][1]) for d in range(60)]  # ties
    docs += [(1000, None), (1001, ""), (1002, " .,; "), (1003, text(20_000)), (None, docs[3][1]), (4, docs[4][1])]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere-to be-found"), (53, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed,k,postings,vocabulary", [(1, 50, 250_000, 200_000), (2, 5, 40, 200_000), (3, 7, 300, 25)])
def test_ranks_match_brute_force(spark, monkeypatch, seed, k, postings, vocabulary):
    monkeypatch.setattr(search, "POSTINGS", postings)
    monkeypatch.setattr(search, "VOCABULARY", vocabulary)
    docs, items = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit("own")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    got = search.ranked(df, asked, k).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(docs, items, k), key=str)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({search.ORACLE})").fetchall()
    got = search.query(spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 1000


def test_blocks_below_the_floor_are_passed_over(spark):
    """An item that stands in long documents only visits few of the blocks of short ones, by its bounds."""
    docs = [(d, "common " * (1 + d % 40) + ("rare words here" if d % 40 < 2 else "filler")) for d in range(2000)]
    asked = spark.createDataFrame([(1, "common rare words here")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = search.ranked(df, asked, 10).collect()
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r["rank"])] == plain(docs, [(1, "common rare words here")], 10)
    assert max(r["visited"] for r in got) <= 4  # of 40


def test_bounds_hold_and_impacts_are_exact():
    rng = np.random.default_rng(2)
    weight = rng.integers(0, 9000, 30)
    term = np.repeat(np.arange(0, 30, 2), 3)
    tfs, sizes = np.tile([9, 4, 1], 15), rng.integers(1, 5, 45)
    postings = np.concatenate([x for t in range(15) for x in np.split(rng.permutation(40)[: sizes[3 * t : 3 * t + 3].sum()], np.cumsum(sizes[3 * t : 3 * t + 3])[:-1])])
    block = search.Block(77, weight, term, tfs, np.cumsum(sizes))
    item = np.array([0, 3, 4, 28])
    scores = block.scores(item, postings, 40)
    want = np.zeros(40, np.int64)
    for g in range(45):
        for d in postings[np.cumsum(sizes)[g] - sizes[g] : np.cumsum(sizes)[g]]:
            if term[g] in item:
                want[d] += int(weight[term[g]]) * (10**9 * int(tfs[g]) // (1000 * int(tfs[g]) + 20 * 77))
    assert (scores == want).all() and block.bounds(item, np.array([0, 4]))[0] >= scores.max() > 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(docs.limit(0), items).count() == search.ranked(docs, items.limit(0)).count() == 0
