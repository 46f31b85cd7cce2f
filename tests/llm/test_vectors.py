"""Embedding links against brute force, with hot groups, copies and vectors that link with nothing."""

from __future__ import annotations

import numpy as np
import pytest

from verbatia.llm import embeddings


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    base = r.normal(size=(300, 24))
    out = [v for v in base]
    for k in range(60):
        out += [base[k] + r.normal(size=24) * s for s in (0.05, 0.2, 0.35)]
    out += [base[0] + r.normal(size=24) * 0.15 for _ in range(150)]  # one large group
    out += [base[7] * 3.0, base[7], base[7], base[8]]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    n = len(vectors)
    return vectors + [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] * 24), (n + 5, [1.0, 2.0]), (n + 6, [1.0, 2.1]), (n + 7, [1e300] * 24)]


def test_links(spark, rows, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in ok}
    links, parent = {i: set() for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                links[i].add(j), links[j].add(i)
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert set(got) == set(links)
    found, real = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert found >= 0.95 * real
    assert sum(got[i].component_id == find(i) for i in links) >= 0.98 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(df).count() == 0


@pytest.mark.parametrize("n", [2000, 12000])
def test_recall_of_planted_links_just_above_the_threshold(spark, n):
    r = np.random.default_rng(n)
    base = r.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = r.normal(size=(n // 2, 64))
    away -= (away * base[: n // 2]).sum(axis=1, keepdims=True) * base[: n // 2]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = r.uniform(0.905, 0.93, size=(n // 2, 1))
    every = np.concatenate([base, c * base[: n // 2] + np.sqrt(1 - c * c) * away])
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(every)], "vec_id long, embedding array<double>, node string").repartition(6)
    got = {x.vec_id: x for x in embeddings.near_vectors(df).collect()}
    real = every @ every.T >= 0.9
    np.fill_diagonal(real, False)
    assert len(got) == len(every) and all(got[i].n_links <= real[i].sum() for i in got)
    assert sum(x.n_links for x in got.values()) >= 0.95 * real.sum() > 0


def test_pivots_grow_with_the_vectors():
    assert [embeddings.pivot_count(n, 16384) for n in (1, 10**4, 10**6, 10**12)] == [16, 400, 4000, 16384]
