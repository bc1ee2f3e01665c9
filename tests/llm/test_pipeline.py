import os
import random
import time

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from terralign.llm import common, simhash


def sets(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("block", [8, 2048])
def test_representatives_against_brute_force(spark, monkeypatch, block):
    if block < 64:
        pairs = simhash.similar_pairs
        monkeypatch.setattr(simhash, "similar_pairs", lambda *a, **k: pairs(*a, **k, block=block, weight=256 * block))
        monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 150))]
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            near = list(base)
            for k in rng.sample(range(len(near)), rng.randint(0, 3)):
                near[k] = word()
            texts.append(near)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs += [(500, None), (501, ""), (502, " "), (503, "two words"), (504, "Two  WORDS"), (None, docs[0][1])] + [(3, docs[3][1])] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'c' as w", "1 as cls")
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    every = [sets(t) for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            a, b = every[i], every[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    key = lambda i: (docs[i][0] is not None, docs[i][0] or 0)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(i)
    want = sorted(str(docs[min(g, key=key)][0]) for g in groups.values())
    got = sorted(str(r.doc_id) for r in simhash.representatives(df).collect())
    assert set(want) <= set(got) and len(got) <= len(want) + 1  # recall is 97 percent at 0.8
    assert simhash.representatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 2048])
def test_true_pairs_among_near_misses(spark, monkeypatch, block):
    """A family just below the similarity, with a few pairs above it: no text is lost behind an edge that fails."""
    pairs = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda *a, **k: pairs(*a, **k, block=block, weight=256 * block))
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, texts = [word() for _ in range(200)], []

    def edited(words):
        out = list(words)
        for k in range(4):
            out[50 * k + rng.randrange(5, 45)] = word()
        return out

    for _ in range(300):
        texts.append(edited(base))
    for k in range(0, 300, 10):
        texts.append(edited(texts[k]))
    every = [sets(" ".join(t)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(every[i] & every[j]) >= 0.8 * len(every[i] | every[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in simhash.representatives(df).collect()}
    assert 20 < len(set(label)) < len(texts) - 10
    assert set(label) <= got and len(got) <= len(set(label)) + 1  # recall is 97 percent at 0.8


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "mel", "su", "ko"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    item = [word() + "q" for _ in range(30)]
    docs, labels = [], []
    for i in range(160):
        w = [word() for _ in range(rng.randint(20, 80))]
        if i % 4 == 1:
            w = [x + "%%%" for x in w]
        if i % 10 == 4:
            w[5:5] = item
        text = " ".join(w)
        if i % 10 == 6:
            text += "\n" + passage
        docs.append((i, text, "en", "src", len(text)))
        if i % 3:
            labels.append((i, int(i % 4 != 1), 0))
    docs += [(200, docs[0][1], "en", "src", 1), (201, docs[2][1] + " one more", "en", "src", 1), (202, None, None, None, None), (203, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < 4:
            assert now.columns == columns
        now.write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = now.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert not {i for i in ids["quality"] if i < 160 and i % 4 == 1} and {i for i in range(160) if i % 4 != 1} <= ids["quality"]
    texts = [r.text or "" for r in seen["line_dedup"]]
    assert sum(passage in t for t in texts) == 1
    assert {0, 2} <= ids["near_dedup"] and not {200, 201} & ids["near_dedup"]
    assert not {i for i in ids["decontamination"] if i < 160 and i % 10 == 4}
    clean = {i for i in ids["near_dedup"] if i >= 160 or i % 10 != 4}
    assert clean == ids["decontamination"] == ids["packing"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in seen["packing"])


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(5)
    text = " ".join(f"W{rng.randrange(40_000)}" for _ in range(150_000))
    words, shingles = simhash.wide_fingerprint(text, 5, 2)
    tokens = text.lower().split()
    h = {xxhash.xxh64_intdigest(" ".join(tokens[i : i + 5]), 42) for i in range(len(tokens) - 4)}
    assert shingles.view("u4").tolist() == sorted({x & 0xFFFFFFFF for x in h})
    assert words[0] & (1 << 64) - 1 == sum((2 * sum(x >> bit & 1 for x in h) > len(h)) << bit for bit in range(64))


def test_tables_of_finished_stages_are_removed(spark, monkeypatch, tmp_path):
    def grown(session, docs, _):
        return common.written(docs.selectExpr("doc_id + 1 as doc_id")).where("doc_id > 1")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", grown), ("b", grown), ("c", grown)])
    spark.range(5).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(common._folder(spark).removeprefix("file://"))) if common.written(spark.range(1)).count() else set()
    with common.noted() as outside:
        common.written(spark.range(1))
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert sorted(r.doc_id for r in out.collect()) == [4, 5, 6, 7]
    left = set(os.listdir(common._folder(spark).removeprefix("file://")))
    assert len(left - before) == 3  # beside what outside names, the last stage's docs
    assert len(outside) == 2 and {os.path.basename(x) for x in outside} <= left  # the caller's own, and that of the last stage


def test_shuffle_files_go_with_the_stored_table(spark):
    setting = spark.conf.get(common.SHUFFLES_GO)
    once = spark.range(20_000).selectExpr("id % 500 as k", "id as v").groupBy("k").agg(F.sum("v").alias("v"))
    both = common.written(once.join(once.withColumnRenamed("v", "w").repartition(3, "k"), "k"))
    assert both.count() == once.count() == 500 and both.where("v = w").count() == 500
    again = common.written(both.groupBy("v").count(), rows=100)
    assert again.count() == 500 and spark.conf.get(common.SHUFFLES_GO) == setting
    trackers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    latest = spark.sparkContext._jsc.sc().newShuffleId()
    common.written(spark.range(900).repartition(4).groupBy("id").count())
    for _ in range(50):
        if not any(trackers.containsShuffle(n) for n in range(latest + 1, latest + 3)):
            break
        time.sleep(0.1)
    assert not any(trackers.containsShuffle(n) for n in range(latest + 1, latest + 3))
