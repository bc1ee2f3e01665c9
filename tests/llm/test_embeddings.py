import numpy as np
import pytest

from terralign.llm import embeddings


def brute(rows, least=0.9):
    good = {}
    for i, (k, v) in enumerate(rows):
        if k is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.asarray(v, float) / np.abs(v).max()
            good[i] = x / np.linalg.norm(x)
    parent = {i: i for i in range(len(rows))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(range(len(rows)), 0)
    for i in good:
        for j in good:
            if i < j and good[i] @ good[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        for i in g:
            out.append((rows[i][0], links[i], min((rows[x][0] for x in g if rows[x][0] is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows", [16, 50, 8192])
def test_against_brute_force(spark, monkeypatch, cell_rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + 0.25 * rng.standard_normal(8)]) for i in range(120)]
    rows += [(300 + i, rows[50][1]) for i in range(30)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0] * 7), (404, []), (None, rows[0][1])]
    rows += [(405, [1e200] * 8), (406, [1.0] * 8), (407, [float("inf")] + [1.0] * 7)]
    rows += [(408, [None] + [1.0] * 7)]
    join = embeddings.range_join
    monkeypatch.setattr(embeddings, "range_join", lambda v, least: join(v, least, cell_rows=cell_rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [(r.vec_id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_text_keys_raise(spark):
    with pytest.raises(TypeError):
        embeddings.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))
