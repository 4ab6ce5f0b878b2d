import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import across, graphs, layout, reduce


def blobs(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 0, 5]])
    x = centre[np.arange(n) % 3] + rng.normal(scale=0.7, size=(n, 4))
    return x, spark.createDataFrame([(i, [float(v) for v in row], *map(float, row)) for i, row in enumerate(x)], "node_id long, vector array<double>, f0 double, f1 double, f2 double, f3 double").cache()


def places(df):
    frame = df.toPandas().sort_values("node_id")
    return frame["node_id"].to_numpy(), np.stack(frame["embedding"].to_list())


def preserved(x, y, k=10):
    """The share of each point's ``k`` nearest that a layout keeps."""
    near = lambda z: np.argsort(((z[:, None] - z) ** 2).sum(2), 1, kind="stable")[:, 1 : k + 1]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x), near(y), strict=True)])


def test_memberships(spark):
    """A row's weights sum to log2 k; repeated vectors weigh 1; the union is a + b - ab."""
    d = np.array([[1.0, 2.0, 4.0, 7.0], [0.0, 0.0, 3.0, np.inf], [0.0, 0.0, 0.0, 0.0]])
    w = layout.memberships(d)
    assert w[0].sum() == pytest.approx(2) and w[0, 0] == 1
    assert w[1].tolist()[:3] == [1, 1, 1] and w[1, 3] == 0 and (w[2] == 1).all()
    rows = spark.createDataFrame([(1, 2, 1, 1.0), (1, 3, 2, 2.0), (1, 4, 3, 4.0), (1, 5, 4, 7.0), (3, 1, 1, 2.0)], "src long, dst long, rank int, distance double")
    got = {(r["i"], r["j"]): r["w"] for r in layout.fuzzy(rows).collect()}
    a = dict(zip([2, 3, 4, 5], w[0], strict=True))
    assert got[1, 2] == got[2, 1] == pytest.approx(1) and got[1, 3] == got[3, 1] == pytest.approx(1)
    assert got[1, 4] == got[4, 1] == pytest.approx(a[4]) and got[5, 1] == pytest.approx(a[5]) and len(got) == 8


def test_pushes_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(0)
    v, y, times = np.arange(40) - 3, rng.normal(size=(40, 2)), rng.integers(0, 30, 40)
    whole = layout.pushes(v, y, times, v[:25], y[:25], 1.5, 0.8, 7)
    monkeypatch.setattr(layout, "SLAB", 11)
    np.testing.assert_allclose(layout.pushes(v, y, times, v[:25], y[:25], 1.5, 0.8, 7), whole)
    # A pool that holds a node alone doesn't push it.
    assert not layout.pushes(v[:1], y[:1], np.array([9]), v[:1], y[:1], 1.5, 0.8, 7).any()
    assert layout.pushes(v[:0], y[:0], times[:0], v[:5], y[:5], 1.5, 0.8, 7).shape == (0, 2)


def test_layout_on_the_cluster_keeps_neighbourhoods(spark):
    x, df = blobs(spark)
    ids, far = places(reduce.umap(df, n_neighbors=10, epochs=25, few=0))
    assert ids.tolist() == list(range(150)) and far.shape == (150, 2) and np.isfinite(far).all()
    _, near = places(reduce.umap(df, n_neighbors=10, epochs=25))
    assert preserved(x, far) > 0.9 * preserved(x, near) > 0.3
    group = np.arange(150) % 3
    within = max(np.linalg.norm(far[group == g] - far[group == g].mean(0), axis=1).mean() for g in range(3))
    between = min(np.linalg.norm(far[group == a].mean(0) - far[group == b].mean(0)) for a, b in ((0, 1), (0, 2), (1, 2)))
    assert between > 2 * within
    graph = layout.fuzzy(graphs.knn(df, "vector", 6, "manhattan"))
    one, two = (places(layout.spread(graph, epochs=2, seed=3))[1] for _ in range(2))
    np.testing.assert_allclose(one, two, atol=1e-6)


@pytest.mark.parametrize("metric", ["manhattan", "euclidean", "cosine"])
def test_new_nodes_are_placed_by_their_nearest(spark, monkeypatch, metric):
    """Against brute force, with bounds by boxes in force."""
    monkeypatch.setattr(across, "FEW", 0)
    x, df = blobs(spark, 400)
    rng = np.random.default_rng(5)
    y = rng.normal(size=(400, 2))
    fitted = df.select("node_id", "vector").join(spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(y)], "node_id long, embedding array<double>"), "node_id")
    z, new = blobs(spark, 60, 9)
    ids, got = places(layout.placed(fitted, new.select("node_id", "vector"), 7, metric))
    assert ids.tolist() == list(range(60))
    for i in range(60):
        if metric == "manhattan":
            d = np.abs(x - z[i]).sum(1)
        elif metric == "euclidean":
            d = np.linalg.norm(x - z[i], axis=1)
        else:
            d = 1 - x @ z[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(z[i])
        near = np.argsort(d, kind="stable")[:7]
        w = layout.memberships(d[near][None])[0]
        np.testing.assert_allclose(got[i], w @ y[near] / w.sum(), atol=1e-6)


def test_fewer_fitted_nodes_than_neighbours(spark):
    fitted = spark.createDataFrame([(1, [0.0, 0.0], [5.0]), (2, [4.0, 0.0], [7.0])], "node_id long, vector array<double>, embedding array<double>")
    new = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, None)], "node_id long, vector array<double>")
    got = dict(zip(*places(layout.placed(fitted, new, 15)), strict=True))
    assert set(got) == {1, 2} and got[2][0] == pytest.approx(6) and 5 <= got[1][0] <= 6


def test_components_are_saved_and_applied(spark, tmp_path):
    columns = ["f0", "f1", "f2", "f3"]
    x, df = blobs(spark)
    path = f"file://{tmp_path}/pca"
    ids, first = places(reduce.reduce(df, columns, "pca", model=path, n_components=2))
    _, plain = places(reduce.reduce(df, columns, "pca", n_components=2))
    np.testing.assert_allclose(first, plain, atol=1e-9)
    z, other = blobs(spark, 40, 4)
    ids, got = places(reduce.reduce(other.withColumnRenamed("node_id", "cell"), columns, "pca", "cell", path))
    s = (x - x.mean(0)) / x.std(0, ddof=1)
    load = np.linalg.svd(s, full_matrices=False)[2][:2].T
    load *= np.sign(load[np.abs(load).argmax(0), range(2)])
    np.testing.assert_allclose(got, (z - x.mean(0)) / x.std(0, ddof=1) @ load, atol=1e-9)
    with pytest.raises(ValueError):
        reduce.reduce(df, columns[:3], "pca", model=path)
    with pytest.raises(ValueError):
        reduce.reduce(df, columns, "umap", model=path)


def test_layouts_are_saved_and_applied(spark, tmp_path):
    columns = ["f0", "f1", "f2", "f3"]
    _, df = blobs(spark)
    path = f"file://{tmp_path}/umap"
    _, first = places(reduce.reduce(df, columns, "umap", model=path, n_neighbors=8, epochs=40))
    _, other = blobs(spark, 45, 8)
    ids, got = places(reduce.reduce(other.withColumn("node_id", F.col("node_id") + 1000), columns, "umap", model=path))
    assert ids.tolist() == list(range(1000, 1045))
    centre = np.array([first[np.arange(150) % 3 == g].mean(0) for g in range(3)])
    nearest = ((got[:, None] - centre) ** 2).sum(2).argmin(1)
    assert (nearest == np.arange(45) % 3).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "node_id long, vector array<double>")
    for few in (0, 100):
        assert reduce.umap(df, epochs=2, few=few).count() == 0


def test_epochs_send_little_to_the_driver(spark, monkeypatch):
    """The pool is that of the least hashes though few rows are asked; no epoch broadcasts its places."""
    state = spark.range(3000).select(F.col("id").alias("v"), F.array(F.rand(1), F.rand(2)).alias("y")).cache()
    monkeypatch.setattr(layout, "POOL", 50)
    every = [r["v"] for r in state.orderBy(F.xxhash64("v", F.lit(4), F.lit(7)), "v").collect()]
    assert [r["v"] for r in layout._pool(state, 3000, 4, 7)] == every[:50]
    # Where the bound lets too few through, or there are few nodes, all are asked.
    assert [r["v"] for r in layout._pool(state, 10**9, 4, 7)] == every[:50]
    assert len(layout._pool(state.limit(20), 20, 4, 7)) == 20
    plans, write = [], layout.written
    monkeypatch.setattr(layout, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    _, df = blobs(spark, 60)
    layout.spread(layout.fuzzy(graphs.knn(df, "vector", 6, "manhattan")), epochs=1)
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]
