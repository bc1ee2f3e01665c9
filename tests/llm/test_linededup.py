import random

import pytest
from pyspark.sql import functions as F

from terralign.llm import linededup


def passage(rng, lines, words):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(lines)]


def brute_earlier(docs, min_words):
    """For each line, whether it lies in a run of min_words words that stands earlier too (by document, then place)."""
    lines = [(d, i, x.strip()) for d, t in docs for i, x in enumerate(t.split("\n")) if x.strip()]
    by_doc = {}
    for d, i, x in lines:
        by_doc.setdefault(d, []).append((i, x))
    out = set()
    ids = [d for d, _ in docs]
    for b, e in enumerate(ids):
        for d in ids[: b + 1]:
            x, y = by_doc.get(d, []), by_doc.get(e, [])
            for p in range(len(x)):
                for q in range(len(y)):
                    if (d, p) < (e, q) and x[p][1] == y[q][1]:
                        n = 0
                        while p + n < len(x) and q + n < len(y) and x[p + n][1] == y[q + n][1]:
                            n += 1
                        if sum(len(x[p + k][1].split()) for k in range(n)) >= min_words:
                            out |= {(e, y[q + k][0]) for k in range(n)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    shared = [passage(rng, 1, 60), passage(rng, 4, 15), passage(rng, 3, 30), passage(rng, 12, 5), passage(rng, 1, 51)]
    common = ["All rights reserved.", "The common line of ten words that stands everywhere here."]
    docs = []
    for d in range(40):
        body = []
        for _ in range(rng.randint(1, 5)):
            body += passage(rng, rng.randint(1, 3), rng.randint(3, 40))
            if rng.random() < 0.5:
                body += rng.choice(shared)
            if rng.random() < 0.5:
                body.append(rng.choice(common))
            if rng.random() < 0.3:
                body.append("  ")
        docs.append((d, "\n".join(body)))
    docs.append((40, docs[3][1]))
    docs.append((41, "\n".join(shared[2] + ["x"] + shared[2])))
    got = {r.doc_id: r for r in linededup.deduped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    repeated = brute_earlier(docs, 50)
    kept_lines = {x.strip() for r in got.values() for x in r.text.split("\n")}
    for d, t in docs:
        lines = t.split("\n")
        kept = got[d].text.split("\n") if got[d].n_removed < len(lines) else []
        assert len(lines) - len(kept) == got[d].n_removed
        gone = [i for i in range(len(lines)) if (d, i) in repeated]
        # nothing goes that does not stand earlier within a run of 50 words
        left = [x for i, x in enumerate(lines) if i not in gone]
        it = iter(kept)
        assert all(any(x == y for y in it) for x in left if x.strip())
        # every content still stands somewhere
        assert all(x.strip() in kept_lines for x in lines)
    for s in shared:
        if sum(len(x.split()) for x in s) >= 50:
            held = [d for d, r in got.items() if "\n".join(s) in r.text]
            assert len(held) <= 1
    assert got[40].n_removed > 0


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(None, long), (1, long), (2, ""), (3, None), (4, "\n\n"), (1, long), (5, "short\nshort"), (6, "\n".join([long] * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "7 as _runs", "8 as _left", "9 as _K")
    got = linededup.deduped(df).collect()
    assert all((r._runs, r._left, r._K) == (7, 8, 9) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.n_removed, r._own_n_lines))
    assert by[None] == [(long, 0, "x")]
    assert [x[:2] for x in by[1]] == [("", 1), ("", 1)]
    assert by[2][0][:2] == ("", 0) and by[3][0][:2] == (None, 0) and by[4][0][:2] == ("\n\n", 0) and by[5][0][:2] == ("short\nshort", 0)
    assert by[6][0][:2] == ("", 3)
    assert linededup.deduped(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_variants_against_brute_force(spark, seed):
    """Families whose earliest place shares too little, or less than a later one: exactly the lines of brute force go."""
    rng = random.Random(seed)
    docs = []
    for _ in range(8):
        family = passage(rng, 8, 12)
        docs.append(passage(rng, 1, 12) + family[:4] + passage(rng, 2, 12))  # 48 words only
        for n in (5, 5, 6, 8, 8):
            a = rng.randint(0, 8 - n)
            docs.append(passage(rng, 1, 9) + family[a : a + n] + [" "] + passage(rng, 2, 12))
    docs.append(["x " * 20] * 5)
    first = [f"L{i} " * 12 for i in range(5)]
    docs += [first[:4] + ["other " * 12], ["a " * 12, *first, "b " * 12], ["c " * 12, *first, "d " * 12]]
    docs = [(i, "\n".join(d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r.text for r in linededup.deduped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = brute_earlier(docs, 50)
    for d, t in docs:
        want = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone and x.strip()]
        assert [x for x in got[d].split("\n") if x.strip()] == want


def test_very_long_text(spark):
    lines = [f"line {i} of a very long text that has ten words" for i in range(20_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["own words"] + lines[7000:7010] + ["others"])), (3, "y" * 500_000)]
    got = {r.doc_id: r for r in linededup.deduped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].text == "own words\nothers" and got[3].n_removed == 0


def test_fingerprints_decide(spark, monkeypatch):
    """Windows that differ in nothing but their fingerprint meet as soon as fingerprints are blanked; few lines are fingerprints."""
    rng = random.Random(4)
    docs = [(d, "\n".join(passage(rng, 120, 5))) for d in range(6)]
    both = passage(rng, 10, 9)  # a window holds 6 lines
    docs += [(10, "\n".join(both)), (11, "\n".join(both))]
    lines = both[:6]
    docs += [(20 + k, "\n".join([*lines[: k % 6], *passage(rng, 1, 9), *lines[k % 6 + 1 :]])) for k in range(90)]  # one line of the six is another
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = {r.doc_id for r in linededup.deduped(df).where("n_removed > 0").collect()}
    assert gone == {11}
    real, seen = linededup.fingerprints, []

    def blanked(lines, min_words):
        out = real(lines, min_words)
        seen.append(out.where("_key < 6").count() / 720)
        return out.withColumn("fp", F.lit(0).cast("long"))

    monkeypatch.setattr(linededup, "fingerprints", blanked)
    assert {r.doc_id for r in linededup.deduped(df).where("n_removed > 0").collect()} > gone
    assert seen[0] < 0.45  # of all lines; windows hold ten here
