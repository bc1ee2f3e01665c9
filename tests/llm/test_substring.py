import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralign.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, size):
    """Each row's words without those of repeated windows, by looking at all windows."""
    texts = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for words in texts:
        gone = set()
        for i in range(len(words) - size + 1):
            if seen[tuple(words[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def corpus(seed, size, vocabulary):
    """Passages at, just under and above the window, in changing contexts, runs, periods, copies, near copies and odd rows."""
    rng = random.Random(seed)
    some = lambda n: [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]
    shared = [some(rng.choice([size - 1, size, size + 1, 2 * size, 5 * size])) for _ in range(8)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "x " * (size - 1)), (4, "x " * (size + 3)), (5, "x " * size), (6, "y z " * size), (7, "y z " * (size // 2) + "y"), (8, "a b c " * (size + 1)), (9, "q " * size)]
    for d in range(10, 90):
        body = []
        for _ in range(rng.randint(1, 4)):
            passage = rng.choice(shared)
            lo = rng.randint(0, 3)
            body += some(rng.randint(0, 2 * size)) + passage[lo : len(passage) - rng.randint(0, 3)]
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(body)))
    docs += [(100 + k, docs[20][1]) for k in range(3)]  # copies
    docs += [(110, docs[30][1]), (110, docs[30][1])]  # a repeated row
    changed = docs[40][1].split()
    changed[len(changed) // 2] = "Ünique"
    return docs + [(120, " ".join(changed)), (None, docs[50][1][:-3]), (121, "é è " * size)]


@pytest.mark.parametrize("seed,size,vocabulary", [(1, 35, 400), (2, 35, 3), (3, 12, 30), (4, 8, 2)])
def test_removes_exactly_the_repeated_windows(spark, seed, size, vocabulary):
    docs = corpus(seed, size, vocabulary)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.deduped(df, size=size).collect()), key=str)
    want = sorted(((d, n, k, None if t is None else left) for (d, t), (n, k, left) in zip(docs, plain(docs, size), strict=True)), key=str)
    assert got == want


def test_long_texts_in_pieces(spark, monkeypatch):
    """A text longer than a piece gives the same names and windows; what crosses the border of pieces counts."""
    rng = np.random.default_rng(3)
    words = substring._names.of(" ".join(f"v{x}" for x in rng.integers(0, 50, 9000)).encode())

    def found(piece):
        monkeypatch.setattr(substring, "PIECE", piece)
        out = {}
        for flat, live, number, place in substring._flat([words, words[100:900]], 35):
            window, name, start, end = substring.anchored(flat, live, 35)
            rest = substring.rests(flat, window, start, end, 35)
            for w, *x in zip(window, name, start - window, end - window, rest, strict=True):
                out[int(number[w]), int(place[w])] = tuple(map(int, x))
        return out

    whole = found(1 << 17)
    assert len(whole) == 9000 - 34 + 800 - 34 and found(500) == whole
    assert all(whole[1, i] == whole[0, i + 100] for i in range(800 - 34))


def test_one_long_text(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(1000)}" for _ in range(60))
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300_000))
    docs = [(1, f"{long} {passage}"), (2, f"{passage} {long[:200]}"), (3, long[-3000:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.n_words, r.n_removed, r.text) for r in substring.deduped(df).orderBy("doc_id").collect()]
    assert got == plain(docs, 35) and got[0][1] > 300


def test_equal_windows_choose_alike():
    """Whatever stands around it, a window chooses the same name in the same place."""
    rng = np.random.default_rng(1)
    for size, alphabet in ((35, 4), (35, 200), (9, 3)):
        core = rng.integers(1, alphabet + 1, size).astype(np.uint64) * np.uint64(0x1234567)
        seen = set()
        for _ in range(60):
            sides = [rng.integers(1, alphabet + 1, rng.integers(0, 50)).astype(np.uint64) * np.uint64(0x1234567) for _ in range(2)]
            words = np.concatenate([[np.uint64(0)], sides[0], core, sides[1], [np.uint64(0)]])
            live = np.ones(len(words), bool)
            live[[0, -1]] = False
            window, name, start, end = substring.anchored(words, live, size)
            k = np.flatnonzero(window == 1 + len(sides[0]))[0]
            seen.add((int(name[k]), int(start[k] - window[k]), int(end[k] - window[k])))
        assert len(seen) == 1


def test_names_decide(spark, monkeypatch):
    """Without names nothing is found: windows meet only through names that occur again."""
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "a " + passage), (2, passage + " b")], "doc_id long, text string")
    assert substring.deduped(docs).agg(F.sum("n_removed")).first()[0] == 100
    counter = iter(range(10**9))
    real = substring.anchored

    def blanked(words, live, size):
        window, name, start, end = real(words, live, size)
        return window, np.array([next(counter) for _ in name], np.uint64), start, end

    texts = [substring._names.of(t.encode()) for t in ("a " + passage, passage + " b")]
    chosen = [real(flat, live, 35)[1] for flat, live, _, _ in substring._flat(texts, 35)]
    assert len(np.unique(np.concatenate(chosen))) < sum(map(len, chosen))
    flat, live, _, _ = next(substring._flat(texts, 35))
    assert len(np.unique(blanked(flat, live, 35)[1])) == len(chosen[0])


def test_clashing_columns_and_empty_table(spark):
    names = ["_text", "_t", "_u", "_k", "_at", "_all", "_row", "n_words", "N_removed", "_who0", "name"]
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").select("*", *(F.lit(n).alias(n) for n in names))
    rows = substring.deduped(docs).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["text"]) for r in rows] == [(2, 0, "a b"), (0, 0, None)]
    assert all(r[n if n.lower() not in ("n_words", "n_removed") else f"_own_{n}"] == n for r in rows for n in names)
    assert substring.deduped(docs.limit(0)).count() == 0


def test_query_gives_the_digest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((d, n, k, hashlib.sha256(left.encode()).hexdigest()) for (d, _), (n, k, left) in zip(rows, plain(rows, 35), strict=True))
    assert sorted(map(tuple, substring.query(spark, "/root/testdata/sf0.001").collect())) == want and any(k for _, _, k, _ in want)
