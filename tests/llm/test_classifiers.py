import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from terralign.llm import labelled, quality, toxicity


def made(n=400):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "mel", "su", "ko"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 120))]
        bad, rude = i % 4 == 1, i % 5 == 2
        if bad:
            w = [x + "%%%" for x in w]
        if rude:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zidiot", "zfool"]) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(w), "clash"))
        if i % 8 != 3:
            labels.append((i, int(not bad), int(rude)))
    docs += [(n, None, "c"), (n + 1, "", "c"), (None, "null key", "c"), (3, docs[3][1], "c")]
    labels += [(None, 1, 1), (0, None, None), (99999, 0, 1)]
    return docs, labels


def test_accuracy_and_odd_rows(spark, tmp_path):
    docs, labels = made()
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for q, truth, parts, at in ((quality.query, lambda i: int(i % 4 != 1), 5, 0), (toxicity.query, lambda i: int(i % 5 == 2), 4, 2)):
        got = q(spark, str(tmp_path)).collect()
        assert len(got) == len(docs)
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
            if r.doc_id is not None:
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == at)
        held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
        assert np.mean([r.predicted == truth(r.doc_id) for r in held]) > 0.95


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.trained(docs, labels, F.lit(True)) is None
    assert [r.score for r in quality.scored(docs, None).collect()] == [0.5, 0.5]
    assert quality.filtered(docs, None).count() == 2
    weights = toxicity.trained(docs, labels, F.lit(True))
    assert weights == {} and toxicity.scored(docs.limit(0), weights).count() == 0
    assert [r.score for r in toxicity.scored(docs, weights).collect()] == [0.5, 0.5]


def test_cosines_are_exact():
    model = quality.Model(np.ones(quality.DIMS, np.float32), np.eye(quality.DIMS, 6, dtype=np.float32), np.zeros((0, 6), np.float32), np.array([1.0, 0, 1, 0, 1]), 3)
    rng = np.random.default_rng(2)
    model.vectors = rng.standard_normal((5, 6)).astype(np.float32)
    model.vectors /= np.linalg.norm(model.vectors, axis=1, keepdims=True)
    texts = ["a b c d e f g h i j k l m n"] * 3
    v = model.embed(quality.counts(texts))[0]
    c = model.vectors @ v
    near = np.argsort(-c)[:3]
    w = np.maximum(c[near], 0) ** 4
    want = (w * model.labels[near]).sum() / w.sum() if w.sum() else model.labels.mean()
    assert np.allclose(model.score(texts, block=2), want, atol=1e-5)


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity.Words, "LIMIT", 50)
    words = toxicity.Words()
    many = [f"w{i}" for i in range(333)]
    fresh = toxicity.Words()
    one = np.concatenate([fresh.of([w]) for w in many[:40]])
    assert np.array_equal(words.of(many)[:40], one) and words.used <= 50


def test_remainder(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long").select(labelled.remainder(F.col("k"), 7).alias("r"))
    assert [x.r for x in df.collect()] == [zlib.crc32(b"1") % 7, -1]


def test_ftrl_against_a_plain_loop():
    """Per-coordinate FTRL-proximal as published, one number at a time."""
    rng = np.random.default_rng(5)
    model, z, n = toxicity.Ftrl(alpha=0.7, beta=0.9, l1=0.4, l2=0.1), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= 0.4:
            return 0.0
        return -(z[i] - 0.4 * np.sign(z[i])) / ((0.9 + np.sqrt(n[i])) / 0.7 + 0.1)

    for _ in range(200):
        at = np.unique(rng.integers(0, 40, 6))
        y = int(at[0] % 3 == 0)
        p = 1 / (1 + np.exp(-sum(weight(i) for i in at)))
        before = {i: weight(i) for i in at}
        for i in at:
            g = p - y
            rate = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / 0.7
            z[i] = z.get(i, 0.0) + g - rate * before[i]
            n[i] = n.get(i, 0.0) + g * g
        model.learn(at, y)
    assert np.allclose(model.weights(np.arange(40)), [weight(i) for i in range(40)]) and np.count_nonzero(model.weights()) > 10


def test_features_against_a_plain_list():
    """Words, two beginnings, bigrams and two skip-grams: as many features as a plain reading has, equal where it is equal."""
    text = "The cat, the CAT sat; insulting insults " * 3
    words = [w.strip(toxicity.AROUND).lower() for w in text.split()]
    plain = [("w", w) for w in words] + [("4", w[:4]) for w in words] + [("6", w[:6]) for w in words]
    plain += [(gap, a, b) for gap in (1, 2, 3) for a, b in zip(words, words[gap:], strict=False)]
    got = np.concatenate(toxicity.features(text)).tolist()
    assert len(got) == len(plain) and len({*zip(got, plain, strict=True)}) == len(set(plain)) == len(set(got))
    assert toxicity.features("") == [] == toxicity.features(" \n")


def test_directions_against_dense_svd():
    rng = np.random.default_rng(3)
    left, right = (np.linalg.qr(rng.standard_normal((k, 8)))[0] for k in (80, 50))
    x = (left * np.array([40, 30, 20, 12, 8, 5, 3, 2.0]) @ right.T + 0.001 * rng.standard_normal((80, 50))).astype(np.float32)
    u, sizes, v = np.linalg.svd(x)
    got = quality.directions(x, 5, 1)
    for k in range(5):
        want = v[k] / np.sqrt(sizes[k])
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-3


def test_votes_against_brute_force():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 6)).astype(np.float32)
    vectors[10:20] = vectors[10]  # ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = (np.arange(40) % 2).astype(float)
    model = quality.Model(np.ones(quality.DIMS, np.float32), rng.standard_normal((quality.DIMS, 6)).astype(np.float32), vectors, labels, 7)
    texts = [" ".join(f"t{k}" for k in rng.integers(0, 90, 12)) for _ in range(30)] + [""]
    for text, score in zip(texts, model.score(texts, block=4), strict=True):
        cosines = (model.embed(quality.counts([text])) @ vectors.T)[0]
        last = sorted(cosines)[-7]
        votes = [(float(c) ** 4, y) for c, y in zip(cosines, labels, strict=True) if c >= last and c > 0]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes) if sum(w for w, _ in votes) > 0 else labels.mean()
        assert abs(score - want) < 1e-6


def test_the_sample_is_bounded_whatever_is_repeated(spark):
    docs = spark.createDataFrame([(1, "a b")] * 500 + [(1, "a c"), (2, "d"), (3, None)], "doc_id long, text string").selectExpr("*", "0 as y", "'k' as _key")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1)] * 3, "doc_id long, quality int")
    got = labelled.sample(docs, labels, "doc_id", "text", "quality", F.lit(True), {0: 5, 1: 5}).collect()
    assert sorted((r.y, r._text) for r in got) == [(0, "d"), (1, ""), (1, "a b")]


def test_very_long_text(spark):
    docs, labels = made(80)
    text = " ".join(f"word{k % 50_000}" for k in range(200_000)) + " zidiot"
    df = spark.createDataFrame([(d, t) for d, t, _ in docs] + [(900, text), (901, "x" * 1_000_000)], "doc_id long, text string")
    ids = spark.createDataFrame([*labels, (900, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.scored(df, quality.trained(df, ids, F.lit(True))).count() == len(docs) + 2
    assert toxicity.scored(df, toxicity.trained(df, ids, F.lit(True))).count() == len(docs) + 2


def test_shards_are_bounded_by_characters(spark):
    """Long texts make more shards than their number does; what is learnt stays the same kind of model."""
    rows = [(k % 2, ("bad words here " if k % 2 else "kind lines there ") * 200 + f"x{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "y int, _text string")
    few, many = toxicity.fit(df), toxicity.fit(df, shard_chars=20_000)
    docs = df.selectExpr("y", "monotonically_increasing_id() as doc_id", "_text as text")
    for weights in (few, many):
        got = {r.doc_id: r.score for r in toxicity.scored(docs, weights).collect()}
        assert all((got[r.doc_id] > 0.5) == bool(r.y) for r in docs.collect())
