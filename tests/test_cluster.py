import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import queries
from netloom.operators import cluster, communities, reduce, screen


def blobs(spark, n=90):
    rng = np.random.default_rng(0)
    centre = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0]])
    x = centre[np.arange(n) % 3] + rng.normal(scale=0.5, size=(n, 3))
    rows = [(i, i % 3, [float(v) for v in x[i]], *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "node_id long, truth int, vector array<double>, f0 double, f1 double, f2 double").cache()


def pure(df, labels):
    table = df.join(labels.where("label >= 0"), "node_id").groupBy("label").agg({"truth": "min"}).count()
    mixed = df.join(labels.where("label >= 0"), "node_id").select("label", "truth").distinct().count()
    return table == mixed


@pytest.mark.parametrize("kind,options", [("leiden", {"resolution": 0.5}), ("ecg", {"resolution": 0.5, "ensemble": 4}), ("spectral", {"n_clusters": 3}), ("gmm", {"n_clusters": 3}), ("hdbscan", {"min_cluster_size": 10})])
def test_planted_clusters(spark, kind, options):
    df = blobs(spark)
    labels, n = cluster.cluster(df, "vector", kind, n_neighbors=10, k_cluster=8, **options)
    assert n >= 2 and labels.count() == 90
    assert pure(df, labels)


def test_flavours_and_errors(spark):
    with pytest.raises(NotImplementedError):
        cluster.cluster(blobs(spark), "vector", flavor="UTAG")
    with pytest.raises(ValueError):
        cluster.cluster(blobs(spark), "vector", "other")


def test_modularity(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "node_id long, label int")
    assert cluster.modularity(edges, labels).first()[0] == pytest.approx(6 / 7 - 2 * (7 / 14) ** 2)
    found = {r["node_id"]: r["label"] for r in cluster.leiden(edges).collect()}
    assert found[0] == found[1] == found[2] != found[3] == found[4] == found[5]


def test_reducers(spark):
    df = blobs(spark)
    scores, loadings = reduce.pca(df, ["f0", "f1", "f2"], 2)
    assert loadings.count() == 3 and all(len(r["scores"]) == 2 for r in scores.collect())
    flat = reduce.biplot(scores).toPandas()
    assert np.ptp(flat.x) == pytest.approx(1)
    layout = reduce.reduce(df, ["f0", "f1", "f2"], "umap", n_neighbors=8, epochs=60)
    y = layout.join(df.select("node_id", "truth"), "node_id").toPandas()
    e, t = np.stack(y.embedding), y.truth.to_numpy()
    within = np.mean([np.linalg.norm(e[t == k] - e[t == k].mean(0), axis=1).mean() for k in range(3)])
    between = np.mean([np.linalg.norm(e[t == a].mean(0) - e[t == b].mean(0)) for a, b in ((0, 1), (0, 2), (1, 2))])
    assert between > within
    assert reduce.reduce(df, ["f0"], "none").count() == 90
    with pytest.raises(ValueError):
        reduce.reduce(df, ["f0"], "tsne")
    assert reduce.reducer_name("none") == "none" and reduce.reducer_name("umap", n_components=2, metric="cosine") == "umap,metric=cosine,n_components=2"


def test_screen_resumes(spark, tmp_path):
    df = blobs(spark).withColumn("sample", F.col("node_id") % 12)
    status = df.selectExpr("sample as key", "cast(sample % 2 as int) as y").distinct()
    settings = screen.grid(["none"], [2], [8], ["euclidean"], [5, 10], {"gmm": [3]}, ["obs", "total"])
    assert len(settings) == 2  # ten neighbours exceed eight
    options = {"c_values": (1.0,), "l1_ratios": (0.0,), "folds": 2, "most_folds": 2, "test_size": 0}
    run = lambda: screen.screen(df, ["f0", "f1", "f2"], status, settings, str(tmp_path), logistic=options)
    first = run()
    assert first.schema == screen.RESULT and first.count() == 2 and {r["n_clusters"] for r in first.collect()} == {3}
    assert sorted(map(tuple, run().collect())) == sorted(map(tuple, first.collect()))


def quality(edges, labels):
    return cluster.modularity(edges, labels).first()[0]


def split_communities(edges, labels):
    """Communities that are in several pieces."""
    label = {r["node_id"]: r["label"] for r in labels.collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
        near.setdefault(r["dst"], set()).add(r["src"])
    assert set(label) == set(near)
    seen, pieces = set(), {}
    for v in label:
        if v not in seen:
            pieces[label[v]] = pieces.get(label[v], 0) + 1
            stack = [v]
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen.add(x)
                    stack += [y for y in near[x] if label[y] == label[x]]
    return [c for c, n in pieces.items() if n > 1]


def test_graphs_are_contracted_on_the_cluster(spark, monkeypatch):
    """Contracting on the cluster costs at most a hundredth of the driver's modularity, and no
    more than the contracted graph is collected."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.uniform(0, 20, (12, 3)), 50, 0) + rng.normal(size=(600, 3))
    points = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "node_id long, v array<double>")
    edges = cluster.knn_edges(points, "v", 8).cache()
    whole = cluster.leiden(edges)
    collected, to_pandas = [], type(edges).toPandas
    monkeypatch.setattr(type(edges), "toPandas", lambda df: collected.append(df.count()) or to_pandas(df))
    parts = cluster.leiden(edges, few=3000).cache()
    assert max(collected) <= 3000 < 2 * edges.count()
    assert quality(edges, parts) > 0.99 * quality(edges, whole)
    assert split_communities(edges, parts) == split_communities(edges, whole) == []
    again = cluster.leiden(edges, few=3000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, parts.collect()))


def test_ensembles_on_the_cluster(spark):
    df = blobs(spark)
    edges = cluster.knn_edges(df, "vector", 8).cache()
    labels = cluster.ecg(edges, resolution=0.5, ensemble=4, few=100).cache()
    assert labels.count() == 90 and pure(df, labels)


def test_nothing_comes_together(spark):
    """At a huge resolution every node is a community of its own."""
    edges = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    labels = cluster.leiden(edges, resolution=1e6, few=10)
    assert labels.select("label").distinct().count() == labels.count() == 61
    assert cluster.leiden(edges.where("false")).count() == 0


def planned(monkeypatch, *modules):
    """The plans of all tables that the modules write from now on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or f(df, name))
    return plans


def ring(spark, n=48, size=12):
    """(graph, nodes): cliques along a ring, all of a clique and its successor in one community."""
    edges = [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if i // size == j // size] + [(i, (i + 1) % n, 1.0) for i in range(size - 1, n, size)]
    graph = communities.both_ends(spark.createDataFrame(edges, "src long, dst long, weight double"))
    nodes = communities.degrees(graph).select(F.lit(0).alias("r"), "v", "k", (F.col("v") / F.lit(2 * size)).cast("long").alias("c"))
    return edges, graph, nodes


def test_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    _, graph, nodes = ring(spark)
    plans = planned(monkeypatch, communities)
    communities.moved(graph, nodes, 1.0, 0, rounds=1)
    communities.contracted(graph, communities.refined(graph, nodes, 1.0, 0, rounds=1).select("v", "part"))
    assert {"moved", "inner", "refined", "contracted"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]


@pytest.mark.parametrize("group", [1_000_000, 10])
def test_refined_parts(spark, monkeypatch, group):
    """Whole cliques come together in one step within tasks; in rounds, what does is connected."""
    monkeypatch.setattr(communities, "GROUP", group)
    edges, graph, nodes = ring(spark)
    rows = communities.refined(graph, nodes, 1.0, 0).collect()
    part, community = ({r["v"]: r[n] for r in rows} for n in ("part", "c"))
    assert len(rows) == 48 and all(community[v] == v // 24 == community[p] for v, p in part.items())
    if group > 10:
        assert len(set(part.values())) == 4 and all(p // 12 == v // 12 for v, p in part.items())
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    assert split_communities(frame(edges, "src long, dst long, weight double"), frame(list(part.items()), "node_id long, label long")) == []


def test_ensembles_send_no_table_to_the_driver(spark, monkeypatch):
    edges, _, _ = ring(spark)
    plans = planned(monkeypatch, cluster, communities)
    monkeypatch.setattr(cluster, "_leiden", lambda graph, *_: graph)
    weighted = cluster.ecg(spark.createDataFrame(edges, "src long, dst long, weight double"), ensemble=2, few=10)
    assert weighted.count() == 2 * len(edges) and weighted.agg(F.max("w")).first()[0] == 1.0
    assert "weighted" in {name for name, _ in plans} and not [name for name, plan in plans if "Broadcast" in plan]


def test_labels_of_a_setting_stay_on_the_cluster(spark, monkeypatch):
    plans, composition = [], screen.niches.composition
    monkeypatch.setattr(screen.niches, "composition", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or composition(df, *a))
    nodes = spark.range(12).select(F.col("id").alias("node_id"), (F.col("id") % 3).alias("sample"))
    labels = spark.range(12).select(F.col("id").alias("node_id"), (F.col("id") % 2).cast("int").alias("label"))
    table, names = screen.features(nodes, labels, "sample", "obs")
    assert names == ["niche_0", "niche_1"] and {tuple(r) for r in table.collect()} == {(k, 0.5, 0.5) for k in range(3)}
    assert len(plans) == 1 and "Broadcast" not in plans[0]


def test_runs_move_together(spark, monkeypatch):
    """A round writes a row for each node, not for each node and run; in blocks nodes move as in one task."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 150, (2, 900)), rng.uniform(0.1, 2, 900), strict=True)] + [(200, 200, 1.0)]
    graph = communities.both_ends(spark.createDataFrame(edges, "src long, dst long, weight double"))
    nodes = communities.degrees(graph).select("v", "k", F.array_repeat("v", 3).alias("c")).cache()
    near, needed, m = communities.blocks(graph)
    rows = []
    monkeypatch.setattr(communities, "written", lambda df, name, f=communities.written: rows.append((out := f(df, name)).count()) or out)
    found = []
    for high in (communities.HIGH, 0):
        monkeypatch.setattr(communities, "HIGH", high)
        found.append({r["v"]: (r["k"], tuple(r["c"])) for r in communities.moved_together(near, needed, m, nodes, 1.0, 0, rounds=3).collect()})
    assert rows == [nodes.count()] * 4 and found[0] == found[1]
    assert found[0][200] == (1.0, (200, 200, 200)) and len({tuple(c[r] for _, c in found[0].values()) for r in range(3)}) == 3
    # The first round by hand: who gains, in its turn, goes where the gain is largest.
    w, k, total = {}, {r["v"]: r["k"] for r in nodes.collect()}, sum(r["k"] for r in nodes.collect())
    for r in graph.where("i <> j").collect():
        w.setdefault(r["i"], {})[r["j"]] = r["w"]
    once = {r["v"]: r["c"] for r in communities.moved_together(near, needed, m, nodes, 1.0, 0, rounds=1).collect()}
    for v in k:
        best = max(((x - k[v] * k[u] / total, -u) for u, x in w.get(v, {}).items()), default=(0.0, -v))
        turns = [communities._turns(np.array([v]), r, 0)[0] for r in range(3)]
        assert list(once[v]) == [-best[1] if t and best[0] > communities.LEAST else v for t in turns]


def test_the_whole_grid(spark, monkeypatch, tmp_path):
    """The query screens all settings over all components; a mixture is fitted once for all graphs."""
    seen, kinds, fitted = [], [], cluster.cluster
    whole = screen.screen
    monkeypatch.setattr(screen, "screen", lambda nodes, columns, status, settings, folder, **options: seen.append((columns, settings, options)) or nodes)
    queries.QUERIES["screen_parameters"](spark, "/root/testdata/sf0.001")
    (columns, settings, options), parts = seen[0], {}
    assert columns == [f"f{i}" for i in range(64)] and not options and len(settings) == len({tuple(s.items()) for s in settings}) == 40_500
    for s in settings:
        assert s["k_cluster"] <= s["n_neighbors"]
        parts.setdefault(s["clusterer_type"], set()).add(s["clust_size_param"])
    assert {k: len(v) for k, v in parts.items()} == {"hdbscan": 2, "spectral": 17, "ecg": 4, "leiden": 5, "gmm": 17} and {s["normalize"] for s in settings} == set(screen.niches.METHODS) - {"counts"}
    monkeypatch.setattr(cluster, "cluster", lambda df, vector, kind, **options: kinds.append((kind, sorted(options))) or fitted(df, vector, kind, **options))
    df = blobs(spark).withColumn("sample", F.col("node_id") % 12)
    status = df.selectExpr("sample as key", "cast(sample % 2 as int) as y").distinct()
    small = screen.grid(["none"], [2], [8], ["euclidean"], [4, 5], {"gmm": [3], "ecg": [2]}, ["obs", "clr"])
    rows = whole(df, ["f0", "f1", "f2"], status, small, str(tmp_path), logistic={"folds": 2, "most_folds": 2, "test_size": 0}).collect()
    assert len(rows) == 8 and sorted(kinds) == [("ecg", ["edges", "ensemble"])] * 2 + [("gmm", ["n_clusters"])]
    assert all(r["n_clusters"] >= 3 and r["score_roc_auc"] is not None and 1e-4 <= r["penalty"] <= 1e4 for r in rows)
