import random

import numpy as np
import pytest
import xxhash

from terralign.llm import simhash


def brute_print(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprint_matches_definition():
    for t in [None, "", " \t", "One two", "ÀÉ A B C d e f g", "a b c d " * 9, "x y z\x0bq r s"]:
        for n in (4, 5):
            assert simhash.fingerprint(t, n) == brute_print(t, n)


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_planted_prints(spark, block):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:25]:
        for _ in range(rng.randint(1, 12)):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block=block).collect()
    at = {x: i for i, x in enumerate(signed)}
    label = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for e in edges:
            assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4
            low = min(label[at[e.a]], label[at[e.b]])
            moved |= label[at[e.a]] != low or label[at[e.b]] != low
            label[at[e.a]] = label[at[e.b]] = low
    assert label == brute_components(prints, 4)


def test_documents(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta " * 4] * 5 + [None, "", "  "] + [f"word{i} other{i} thing{i} more{i} again{i}" for i in range(10)]
    docs = spark.createDataFrame([(100 - i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp, r.component) for r in simhash.near_duplicates(docs, words=4).collect()}
    assert len(got) == len(texts)
    prints = [brute_print(t, 4) for t in texts]
    roots = brute_components(prints, 4)
    for i in range(len(texts)):
        assert got[100 - i][0] & (2**64 - 1) == prints[i]
        assert got[100 - i][1] == min(100 - j for j in range(len(texts)) if roots[j] == roots[i])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
