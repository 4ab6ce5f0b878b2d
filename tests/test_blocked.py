"""Exact searches by blocks against brute force."""

import numpy as np
import pytest

from netloom.operators import blocked, graphs


def vectors(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "node_id long, v array<double>").repartition(parts)


def got(df, k, metric="euclidean"):
    out = {}
    for r in graphs.knn(df, "v", k, metric).collect():
        out.setdefault(r["src"], {})[r["rank"]] = (r["dst"], r["distance"])
    return {i: [v[j] for j in sorted(v)] for i, v in out.items()}


def brute(x, k, metric="euclidean"):
    x = np.asarray(x, float)
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1)
        u = x / np.maximum(norm, 1e-300)[:, None]
        d = ((u[:, None] - u) ** 2).sum(-1) / 2
        d[norm == 0] = d[:, norm == 0] = 1
    elif metric == "manhattan":
        d = np.abs(x[:, None] - x).sum(-1)
    else:
        d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    root = np.sqrt if metric == "euclidean" else lambda v: v
    return {i: [(int(j), float(root(d[i, j]))) for j in np.lexsort((np.arange(len(x)), d[i]))[:k] if d[i, j] < np.inf] for i in range(len(x))}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 16)
    monkeypatch.setattr(blocked, "BOXES", 3)
    monkeypatch.setattr(blocked, "SLAB", 100)


@pytest.mark.parametrize("metric", blocked.METRICS)
@pytest.mark.parametrize("dim", [1, 2, 11])
def test_all_metrics(spark, small, metric, dim):
    x = np.random.default_rng(dim).normal(size=(150, dim)).round(2)
    x[:20] = x[20:40]
    x[40] = 0
    want, have = brute(x, 5, metric), got(vectors(spark, x), 5, metric)
    for i in want:
        assert [j for j, _ in have[i]] == [j for j, _ in want[i]] and np.allclose([d for _, d in have[i]], [d for _, d in want[i]], atol=1e-12)


@pytest.mark.parametrize("dim", [2, 12])
def test_equal_vectors_and_equal_distances(spark, small, dim):
    same = got(vectors(spark, np.ones((60, dim))), 3)
    assert [j for j, _ in same[50]] == [0, 1, 2] and [j for j, _ in same[1]] == [0, 2, 3]
    star = np.zeros((41, dim))
    star[1:, 0], star[1:21, 0] = 1, -1
    assert [j for j, _ in got(vectors(spark, star), 3)[0]] == [1, 2, 3]


@pytest.mark.parametrize("dim", [1, 12])
def test_large_coordinates(spark, small, dim):
    x = np.full((200, dim), 1e8)
    x[:, 0] += np.arange(200) / 2
    have = got(vectors(spark, x), 2)
    assert have[10] == [(9, 0.5), (11, 0.5)] and have == brute(x, 2)


def test_few_points_and_odd_rows(spark):
    assert got(vectors(spark, [[0.0, 0], [1, 0]]), 5) == {0: [(1, 1.0)], 1: [(0, 1.0)]}
    rows = [(0, [0.0]), (1, [1.0]), (2, None), (None, [3.0]), (3, [float("nan")]), (4, [None]), (5, [float("inf")])]
    df = spark.createDataFrame(rows, "node_id long, v array<double>")
    assert got(df, 3) == {0: [(1, 1.0)], 1: [(0, 1.0)]} and got(df.where("false"), 3) == {}
    with pytest.raises(ValueError, match="lengths"):
        got(spark.createDataFrame([(0, [0.0]), (1, [1.0, 2.0])], "node_id long, v array<double>"), 1)
    with pytest.raises(ValueError, match="metric"):
        got(df, 1, "hamming")


def test_only_near_blocks_meet(spark, monkeypatch):
    """30,000 points of the plane: many tasks, each pair of blocks a key, far fewer pairs than all."""
    x = np.random.default_rng(0).uniform(size=(30_000, 2))
    own = blocked.blocks(blocked.vectors(vectors(spark, x), "v", "node_id"), 5, "euclidean")
    n = own.count()
    met = blocked.pairs(own, "euclidean").collect()
    assert n >= 8 and len(set(met)) == len(met) < n * (n - 1) / 2
    monkeypatch.setattr(blocked, "BLOCK", 256)
    own = blocked.blocks(blocked.vectors(vectors(spark, x), "v", "node_id"), 5, "euclidean")
    n = own.count()
    assert n > 100 and blocked.pairs(own, "euclidean").count() < 12 * n
