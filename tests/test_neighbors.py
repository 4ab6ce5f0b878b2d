import numpy as np
import pandas as pd
import pytest

from netloom.operators import blocked, graphs, neighbors
from netloom.sources import fixtures

K = ("patient", "sample")
TREE = [(0, 10), (0, 20), (0, 30), (10, 110), (10, 210), (10, 310), (20, 120), (20, 220), (20, 320), (30, 130), (30, 230), (30, 330)]


def network(spark, pairs, ids=None):
    ids = sorted({x for p in pairs for x in p} | set(ids or ()))
    nodes = spark.createDataFrame([("0", "s", i) for i in ids], "patient string, sample string, node_id long")
    return nodes, spark.createDataFrame([("0", "s", *p) for p in pairs], "patient string, sample string, source long, target long")


def test_k_hop_levels(spark):
    nodes, edges = network(spark, TREE)
    found = neighbors.k_hop(nodes, edges, 2, K).where("n = 0").collect()
    levels = {h: sorted(r["m"] for r in found if r["hop"] == h) for h in (0, 1, 2)}
    assert levels == {0: [0], 1: [10, 20, 30], 2: [110, 120, 130, 210, 220, 230, 310, 320, 330]}


def test_nas_known_values(spark):
    nodes = spark.createDataFrame([("0", "s", i, *(float(10 * i + j) for j in range(5))) for i in range(5)], "patient string, sample string, node_id long, v0 double, v1 double, v2 double, v3 double, v4 double")
    edges = network(spark, [(0, 1), (2, 3), (3, 4)])[1]
    rows = neighbors.nas(nodes, edges, [f"v{j}" for j in range(5)], 1, "mean-max-std", " - ", K).orderBy("node_id").collect()
    assert [r["v0 - mean"] for r in rows] == [5, 5, 25, 30, 35] and [r["v0 - max"] for r in rows] == [10, 10, 30, 40, 40]
    assert [r["v0 - std"] for r in rows] == pytest.approx([5, 5, 5, 8.16496580927726, 5])
    assert all(r[f"v{j} - mean"] == r["v0 - mean"] + j for r in rows for j in range(5))


def test_isolated_loops_repeats(spark):
    nodes, edges = network(spark, [(0, 0), (1, 2), (1, 2)], [9])
    found = sorted((r["n"], r["m"], r["hop"]) for r in neighbors.k_hop(nodes, edges, 3, K).collect())
    assert found == [(0, 0, 0), (1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (9, 9, 0)]
    assert neighbors.one_hop(edges, K).count() == 6


def test_stubs_and_twin():
    assert neighbors.aggregate_k_neighbors is neighbors.nas
    for f in (neighbors.stagate, neighbors.hmrf_niches):
        with pytest.raises(NotImplementedError):
            f()


def test_smoothed(spark):
    nodes, edges = fixtures.network(spark, "p")
    assert all(len(r["features"]) == 2 for r in neighbors.smoothed(nodes, edges, ["a", "b", "c"], 2, K).collect())


def test_knn_against_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, v array<double>")
    for metric, d in (("euclidean", ((x[:, None] - x) ** 2).sum(2) ** 0.5), ("manhattan", np.abs(x[:, None] - x).sum(2))):
        np.fill_diagonal(d, np.inf)
        got = {(r["src"], r["rank"]): r["dst"] for r in graphs.knn(df, "v", 4, metric).collect()}
        assert got == {(i, k + 1): int(np.argsort(d[i])[k]) for i in range(60) for k in range(4)}


def test_delaunay_circles_are_empty():
    xy = np.random.default_rng(1).random((40, 2))
    edges = {tuple(e) for e in graphs.delaunay(xy).tolist()}
    triangles = [(i, j, k) for i, j in edges for k in range(j + 1, 40) if (i, k) in edges and (j, k) in edges]
    assert len(edges) == 3 * 40 - 3 - _hull(xy)
    for i, j, k in triangles:
        a = np.array([xy[j] - xy[i], xy[k] - xy[i]]) * 2
        c = np.linalg.solve(a, (a * a).sum(1) / 4) + xy[i]
        inside = (((xy - c) ** 2).sum(1) < ((xy[i] - c) ** 2).sum() * (1 - 1e-9)).sum()
        if inside:  # three edges around other triangles
            assert any(_within(xy[p], xy[[i, j, k]]) for p in range(40) if p not in (i, j, k))


def _hull(xy):
    on = set()
    for i in range(len(xy)):
        for j in range(len(xy)):
            if i != j:
                d = xy - xy[i]
                side = (xy[j] - xy[i])[0] * d[:, 1] - (xy[j] - xy[i])[1] * d[:, 0]
                if (np.delete(side, [i, j]) > 0).all():
                    on |= {i, j}
    return len(on)


def _within(p, t):
    s = [np.sign((t[(k + 1) % 3] - t[k])[0] * (p - t[k])[1] - (t[(k + 1) % 3] - t[k])[1] * (p - t[k])[0]) for k in range(3)]
    return abs(sum(s)) == 3


def test_delaunay_degenerate(spark):
    assert len(graphs.delaunay(np.zeros((0, 2)))) == 0 and len(graphs.delaunay(np.array([[0.0, 0.0], [0.0, 0.0]]))) == 0
    nodes, _ = fixtures.network(spark, "trigonal")
    edges = graphs.build_delaunay(nodes)
    assert edges.count() >= 9 and edges.where("source >= target").count() == 0


def test_link_isolated(spark):
    nodes, edges = fixtures.network(spark, "low")
    linked = graphs.link_isolated(nodes, edges.where("source <> 3 and target <> 3"))
    assert sorted((r["source"], r["target"]) for r in linked.where("source = 3 or target = 3").collect()) == [(2, 3), (3, 4)]


def test_user_statistics(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    nodes, edges = network(spark, [(0, 1), (1, 2)])
    nodes = nodes.withColumn("n", F.col("node_id").cast("double"))
    by_name = neighbors.nas(nodes, edges, ["n"], 1, {"range": lambda c: F.max(c) - F.min(c)}, keys=K)
    assert {r["node_id"]: r["n range"] for r in by_name.collect()} == {0: 1, 1: 2, 2: 1}
    assert {r["node_id"]: r["n spread"] for r in neighbors.nas(nodes, edges, ["n"], 1, {"spread": spread}, keys=K).collect()} == {0: 1, 1: 2, 2: 1}


def test_k_hop_plans_grow_by_a_join_a_step(spark):
    nodes, edges = fixtures.network(spark, "low")
    joins = [neighbors.k_hop(nodes, edges, order)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for order in (1, 2, 3, 4)]
    assert joins == [1, 2, 3, 4]


def test_delaunay_keeps_flat_triangles_at_the_rim():
    """The hull's edges are part of a triangulation, however flat their triangles."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        x = np.sort(rng.uniform(0, 1, 30))
        pts = np.r_[np.c_[x, 1e-4 * x * (1 - x)], [[0.5, 1.0]]]
        edges = set(map(tuple, graphs.delaunay(pts).tolist()))
        # The points bend upwards, so the lower hull is its two ends alone.
        assert (0, 29) in edges


def test_knn_blocks_in_groups(spark, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 5)
    monkeypatch.setattr(blocked, "BOXES", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, v array<double>").repartition(3)
    got = {(r["src"], r["rank"]): r["dst"] for r in graphs.knn(df, "v", 4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:4])}


def test_rounded_distances_tie(spark, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 2)
    at = [(0, 0.0), (1, 1.0000002), (2, 1.0000001), (3, -1.0000003), (4, 1.5)]
    df = spark.createDataFrame([(i, [v]) for i, v in at], "node_id long, v array<double>")
    first = lambda digits: [r["dst"] for r in graphs.knn(df, "v", 2, digits=digits).where("src = 0").orderBy("rank").collect()]
    assert first(None) == [2, 1] and first(6) == [1, 2]


@pytest.mark.parametrize("metric", blocked.METRICS)
@pytest.mark.parametrize("few", [0, 10_000])
def test_copies_are_searched_once(spark, monkeypatch, metric, few):
    monkeypatch.setattr(graphs, "VECTORS", few)
    rng = np.random.default_rng(3)
    x = np.array([[0, 0], [1, 0], [0, 2], [1, 1], [3, 3]], float)[rng.choice(5, 160, p=[0.4, 0.3, 0.2, 0.08, 0.02])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node_id long, v array<double>")
    searched, blocks = [], blocked.blocks
    monkeypatch.setattr(blocked, "blocks", lambda own, *rest: searched.append(own.count()) or blocks(own, *rest))
    got = {(r["src"], r["rank"]): (r["dst"], round(r["distance"], 9)) for r in graphs.knn(df, "v", 3, metric).collect()}
    assert searched[0] <= 5 * 4
    flat = blocked.flat(x, metric)
    want = {}
    for i in range(len(x)):
        d = blocked.exact(np.repeat(flat[i : i + 1], len(x), 0), flat, metric)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:3]
        want |= {(i, r + 1): (j, round(float(np.sqrt(d[j]) if metric == "euclidean" else d[j]), 9)) for r, j in enumerate(order)}
    assert got == want
