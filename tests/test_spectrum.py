import numpy as np
import pytest
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import functions as F

from netloom.operators import cluster, spectrum
from netloom.operators.communities import both_ends


def planted(spark, groups=6, size=25, inner=0.5, outer=0.04, seed=3):
    """(edges, truth) of a random graph whose groups are denser inside."""
    rng = np.random.default_rng(seed)
    truth = np.repeat(np.arange(groups), size)
    i, j = np.triu_indices(len(truth), 1)
    on = rng.random(len(i)) < np.where(truth[i] == truth[j], inner, outer)
    rows = [(int(a) * 7 + 1, int(b) * 7 + 1, 1.0) for a, b in zip(i[on], j[on], strict=True)]
    return spark.createDataFrame(rows, "src long, dst long, weight double").cache(), {int(v) * 7 + 1: int(t) for v, t in enumerate(truth)}


def agreement(truth, labels):
    """The share of nodes whose label's commonest group is their own."""
    groups = {}
    for v, label in labels.items():
        groups.setdefault(label, []).append(truth[v])
    return sum(max(map(g.count, set(g))) for g in groups.values()) / len(labels)


def found(labels):
    return {r["node_id"]: r["label"] for r in labels.collect()}


def dense(edges):
    rows = edges.collect()
    ids = sorted({v for r in rows for v in (r["src"], r["dst"])})
    at = {v: n for n, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for r in rows:
        a[at[r["src"]], at[r["dst"]]] = a[at[r["dst"]], at[r["src"]]] = max(a[at[r["src"]], at[r["dst"]]], r["weight"])
    d = np.sqrt(a.sum(1))
    return ids, a / np.outer(d, d)


@pytest.mark.parametrize("few", [0, 10**6])
def test_eigenvectors_are_those_of_the_dense_matrix(spark, few):
    edges, _ = planted(spark, 4, 15, outer=0.03)
    ids, a = dense(edges)
    want, vectors = np.linalg.eigh(a)
    rows, values = spectrum.leading(both_ends(edges), 4, few=few)
    assert isinstance(rows, spectrum.Spread) == (few == 0)
    np.testing.assert_allclose(values, want[::-1][:4], atol=1e-6)
    frame = rows.table(spark).toPandas().sort_values("v")
    assert frame["v"].tolist() == ids
    x = np.stack(frame["x"].to_list())
    np.testing.assert_allclose(x.T @ x, np.eye(4), atol=1e-6)
    # The spaces agree, whatever the signs.
    np.testing.assert_allclose(x @ x.T, vectors[:, -4:] @ vectors[:, -4:].T, atol=1e-3)


def test_cut_finds_what_power_iteration_misses(spark):
    edges, truth = planted(spark)
    labels = found(cluster.spectral(edges, 6))
    assert set(labels) == set(truth) and agreement(truth, labels) > 0.97
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    model = PowerIterationClustering(k=6, maxIter=20, initMode="degree", weightCol="weight")
    old = {r["id"]: r["cluster"] for r in model.assignClusters(pairs).collect()}
    assert agreement(truth, old) < 0.8


def test_cut_on_the_cluster_is_that_of_the_driver(spark):
    edges, truth = planted(spark, 3, 20)
    one, two = found(cluster.spectral(edges, 3)), found(cluster.spectral(edges, 3, few=0))
    assert agreement(one, two) == agreement(two, one) == 1 and agreement(truth, two) > 0.97


def test_parts_without_links_and_small_graphs(spark):
    """Separate parts have one eigenvalue several times over; a cut has no more parts than nodes."""
    ring = [(10 * g + i, 10 * g + (i + 1) % 8, 1.0) for g in range(3) for i in range(8)]
    edges = spark.createDataFrame([*ring, *ring[:5], (99, 98, 0.0)], "src long, dst long, weight double")
    for few in (0, 1000):
        labels = found(cluster.spectral(edges, 3, few=few))
        assert len(labels) == 24
        assert len({(v // 10, label) for v, label in labels.items()}) == len(set(labels.values())) == 3
    pair = spark.createDataFrame([(1, 2, 1.0), (3, 3, 1.0), (None, 4, 1.0)], "src long, dst long, weight double")
    assert set(found(cluster.spectral(pair.where("src is not null"), 10))) == {1, 2, 3}
    assert cluster.spectral(edges.where("false"), 3).count() == 0
