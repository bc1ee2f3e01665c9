import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np

from terralign.llm import lm


def small(monkeypatch, states=2, classes=5):
    monkeypatch.setattr(lm, "STATES", states)
    monkeypatch.setattr(lm, "CLASSES", classes)


def brute_likelihood(m, seq):
    return sum(m.start[p[0]] * math.prod(m.emit[s, c] for s, c in zip(p, seq, strict=True)) * math.prod(m.move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(len(m.start)), repeat=len(seq)))


def test_forward_and_counts_match_enumeration(monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(0)
    m = lm.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(5), 2))
    seqs = [np.array(x) for x in ([0], [1, 2], [3, 3, 4, 0], [2, 1, 0, 4, 3, 2], [4, 0])]
    assert np.allclose(lm.forward(m, seqs), [math.log10(brute_likelihood(m, s)) for s in seqs])
    want = np.zeros(2 + 4 + 10)
    for s in seqs:
        total = brute_likelihood(m, s)
        for p in itertools.product(range(2), repeat=len(s)):
            w = m.start[p[0]] * math.prod(m.emit[a, c] for a, c in zip(p, s, strict=True)) * math.prod(m.move[a, b] for a, b in zip(p, p[1:], strict=False)) / total
            want[p[0]] += w
            for a, b in zip(p, p[1:], strict=False):
                want[2 + 2 * a + b] += w
            for a, c in zip(p, s, strict=True):
                want[6 + 5 * a + c] += w
    assert np.allclose(lm.expected(m, seqs), want)


def test_documents(spark, tmp_path):
    rng = random.Random(3)
    vocab = [["".join(rng.choice("aeiou" if k else "bcdfg") for _ in range(rng.randint(1, 6))) for _ in range(60)] for k in range(2)]
    docs = [(i, " ".join(rng.choice(vocab[i % 2]) for _ in range(rng.randint(0, 60))).upper() if i % 3 else " ".join(rng.choice(vocab[i % 2]) for _ in range(80))) for i in range(150)]
    docs += [(200, None), (201, "  "), (None, "null key"), (0, docs[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'c' as score").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    counts, n = {}, 0
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = lambda t: (t or "").lower().split() + [None]
    for d, t in docs:
        if not held(d):
            for w in toks(t):
                counts[w] = counts.get(w, 0) + 1
                n += 1
    want = sorted((str(d), held(d), len(toks(t)), sum(counts.get(w, 0) > 0 for w in toks(t)), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in toks(t)), 6)) for d, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_rare_words_meet_their_counts_in_the_join(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "a b c " * (i % 4) + f"w{i % 7} x{i}") for i in range(60)], "doc_id long, text string")
    one, two = ([(r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 6)) for r in lm.scored(docs, F.col("doc_id") < 40, common_words=n).orderBy("doc_id").collect()] for n in (1 << 19, 2))
    assert [x[:3] for x in one] == [x[:3] for x in two] and np.allclose([x[3] for x in one], [x[3] for x in two])
    assert lm.scored(docs.limit(0), F.lit(True)).count() == 0
    untrained = lm.scored(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_probabilities_of_all_short_texts_stay_below_one(spark):
    """The model spends at most 1 on known words, what is not known, and the end."""
    from pyspark.sql import functions as F

    words = ["aa", "bb", "cc", "dd"]
    docs = [(i, " ".join(w)) for i, w in enumerate([p for n in range(4) for p in itertools.product(words, repeat=n)])]
    got = lm.scored(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(True)).collect()
    assert sum(10**r.score for r in got) <= 1 + 1e-9


def test_pieces_of_a_long_text_count_as_the_whole():
    rng = np.random.default_rng(8)
    model = lm.Hmm.initial(rng.integers(1, 9, lm.CLASSES).astype(float))
    seq = rng.integers(0, lm.CLASSES, 100)
    whole = lm.expected(model, [seq])
    for piece in (1, 7, 50, 100, 1000):
        assert np.allclose(lm.expected_long(model, seq, piece), whole, rtol=1e-3, atol=1e-5)


def test_likelihood_rises_with_each_round(spark):
    rng = np.random.default_rng(9)
    sets = [rng.integers(1, 60, 30), rng.integers(60, 120, 30)]
    docs = []
    for _ in range(80):
        at, out = 0, []
        for _ in range(rng.integers(5, 60)):
            at = at if rng.random() < 0.8 else 1 - at
            out.append(rng.choice(sets[at]))
        docs.append(np.append(out, lm.END))
    df = spark.createDataFrame([(bytearray(d.astype("<u2").tobytes()),) for d in docs], "seq binary")
    model = lm.Hmm.initial(np.bincount(np.concatenate(docs), minlength=lm.CLASSES).astype(float))
    seen = [lm.forward(model, docs).sum()]
    for _ in range(4):
        model = lm.baum_welch(df, model)
        seen.append(lm.forward(model, docs).sum())
    assert all(b > a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 10


def test_every_round_counts_every_training_document(spark):
    """Scores are those of a model whose last counts sum over all documents, more than any sample that training might start from."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("ab cd ef gh ij kl mn op".split()[i % 2 :: 2]) for _ in range(rng.randint(1, 12)))) for i in range(2600)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scored(docs, F.lit(True)).collect()}
    read = lm.read_texts(docs, "doc_id", "text", F.lit(True)).withColumn("slice", F.pmod(F.xxhash64("_key", "seq"), F.lit(4))).collect()
    seqs = {r["_key"]: np.frombuffer(r["seq"], "<u2") for r in read}
    frequency, kinds = (np.bincount(x, minlength=lm.CLASSES).astype(float) for x in (np.concatenate(list(seqs.values())), [c for c, _ in {(c, h) for r in read for c, h in zip(r["class"], r["h"], strict=True)}]))
    model, counts = lm.Hmm.initial(frequency), {}
    for _ in range(3):
        for k in range(4):
            counts[k] = lm.expected(model, [seqs[r["_key"]] for r in read if r["slice"] == k])
            model = lm.Hmm.of_counts(sum(counts.values()))
    assert math.isclose(sum(c[: lm.STATES].sum() for c in counts.values()), len(got), rel_tol=1e-5)
    words = {}
    for r in read:
        for h, c, tf in zip(r["h"], r["class"], r["tf"], strict=True):
            words[h] = (c, words.get(h, (c, 0))[1] + tf)
    share = {h: math.log10((n + 1) / (frequency[c] + kinds[c] + 1)) for h, (c, n) in words.items()}
    want = dict(zip(seqs, lm.forward(model, list(seqs.values())), strict=True))
    for r in read:
        assert math.isclose(got[r["_key"]].score, want[r["_key"]] + sum(tf * share[h] for h, tf in zip(r["h"], r["tf"], strict=True)), abs_tol=1e-3)


def test_blocks_of_steps_count_as_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    model = lm.Hmm.initial(rng.integers(1, 9, lm.CLASSES).astype(float))
    docs = [rng.integers(0, lm.CLASSES, n) for n in (1, 9, 9, 9, 4, 30, 2, 30, 17)]
    whole, likely = lm.expected(model, docs), lm.forward(model, docs)
    assert np.allclose(whole, sum(lm.expected_long(model, d) for d in docs), rtol=1e-3, atol=1e-5)
    for block in (1, 2, 5, 16, 40):
        monkeypatch.setattr(lm, "BLOCK", block)
        assert np.allclose(lm.expected(model, docs), whole, rtol=1e-3, atol=1e-5) and np.allclose(lm.forward(model, docs), likely)


def test_recursions_hold_little_memory():
    """They held 66 and 77 MB here, in each worker, when all arrays were as long as the group of documents."""
    rng = np.random.default_rng(6)
    model = lm.Hmm.initial(rng.integers(1, 9, lm.CLASSES).astype(float))
    docs = [rng.integers(0, lm.CLASSES, 1024).astype("<u2") for _ in range(512)]
    for f in (lm.expected, lm.forward):
        tracemalloc.start()
        f(model, docs)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6


def test_batches_are_bounded_by_bytes_and_settings_come_back(spark):
    """Long texts don't meet in one batch, whatever the number of rows."""
    from pyspark.sql import functions as F

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = {name: spark.conf.get(name) for name in lm.BATCH}
    docs = spark.range(64, numPartitions=1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    with lm.small_batches(spark):
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 64 and max(got) <= 1 + int(lm.BATCH["spark.sql.execution.arrow.maxBytesPerBatch"]) // 1_000_000
    seen = {}
    counts, stored = lm.expected_counts, lm.written
    lm.expected_counts = lambda *a: seen.update(count={n: spark.conf.get(n) for n in lm.BATCH}) or counts(*a)
    lm.written = lambda df, rows=None: seen.update(store={n: spark.conf.get(n) for n in lm.BATCH}) or stored(df, rows=rows)
    try:
        lm.scored(spark.range(8).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), F.lit(True)).count()
    finally:
        lm.expected_counts, lm.written = counts, stored
    assert seen == {"count": lm.BATCH, "store": lm.BATCH} and {name: spark.conf.get(name) for name in lm.BATCH} == before
