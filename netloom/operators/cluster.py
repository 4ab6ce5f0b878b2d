"""Clustering of embeddings and of their neighbour graphs.

Graphs of more than ``FEW`` edges are contracted on the cluster until they have no more
(``communities``); only what is left of them is finished on the driver.  Spectral cuts take products
on the cluster above ``FEW`` edges (``spectrum``); mixtures are Spark's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import density, spectrum
from netloom.operators.blocked import written
from netloom.operators.communities import blocks, both_ends, connected, degrees, edges_of, met, moved_together, settled, shrunk
from netloom.operators.curate import relabel
from netloom.operators.graphs import knn

#: Edges, from both ends, of a graph that the driver finishes.
FEW = 200_000


def _arrays(graph: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, i, j, w) of a graph of at most FEW rows (i, j, w)."""
    frame = graph.toPandas().sort_values(["i", "j"])
    ids = np.unique(frame["i"].to_numpy(np.int64))
    return ids, np.searchsorted(ids, frame["i"]), np.searchsorted(ids, frame["j"]), frame["w"].to_numpy(float)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of labels (node_id, label) on undirected edges (src, dst, weight)."""
    at = lambda end, out: labels.select(F.col("node_id").alias(end), F.col("label").alias(out))
    ends = edges.join(at("src", "x"), "src").join(at("dst", "y"), "dst")
    inner = ends.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    degree = ends.select(F.explode(F.array("x", "y")).alias("l"), "weight").groupBy("l").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("d2"))
    m = F.nullif("m", F.lit(0.0))
    return inner.join(degree).select((F.col("inside") / m - F.lit(float(resolution)) * F.col("d2") / (4 * m * m)).alias("modularity"))


def leiden_labels(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0, levels: int = 50, start: np.ndarray | None = None) -> np.ndarray:
    """Communities by local moving, refinement within communities and aggregation, in turn; ``start``
    are the communities that nodes begin in, else each is its own."""
    rng, whole, ends = np.random.default_rng(seed), np.arange(n), (i, j)
    label = np.arange(n) if start is None else start
    for _ in range(levels):
        moved = np.unique(settled(n, i, j, w, resolution, rng, label), return_inverse=True)[1]
        refined = np.unique(settled(n, i, j, w, resolution, rng, np.arange(n), moved), return_inverse=True)[1]
        m = int(refined.max()) + 1 if n else 0
        if m == n:
            return connected(moved[whole], *ends)
        community = np.zeros(m, np.int64)
        community[refined] = moved
        key = refined[i] * m + refined[j]
        pairs, at = np.unique(key, return_inverse=True)
        i, j, w = pairs // m, pairs % m, np.bincount(at, w)
        whole, n = refined[whole], m
        # Each community is named by one of its members, so labels stay below n.
        first = np.full(int(community.max()) + 1, n)
        np.minimum.at(first, community, np.arange(n))
        label = first[community]
    return connected(label[whole], *ends)


def _labelled(spark, ids: np.ndarray, labels: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, labels, strict=True)], "node_id long, label int")


def knn_edges(df: DataFrame, vector: str, k: int, metric: str = "euclidean", node_id: str = "node_id") -> DataFrame:
    """(src, dst, weight) of the neighbour graph."""
    return knn(df, vector, k, metric, node_id).select("src", "dst", F.lit(1.0).alias("weight"))


def leiden(edges: DataFrame, resolution: float = 1.0, seed: int = 0, few: int | None = None) -> DataFrame:
    """(node_id, label): connected communities of edges (src, dst, weight), by Leiden's method."""
    return _leiden(both_ends(edges), resolution, seed, FEW if few is None else few)


def _leiden(graph: DataFrame, resolution: float, seed: int, few: int) -> DataFrame:
    """Graphs that are contracted are gone through twice, the second time from the first result."""
    labels = _pass(graph, resolution, seed, few)
    if graph.count() <= few:
        return labels
    return _pass(graph, resolution, seed + 7919, few, written(labels.select(F.col("node_id").alias("v"), F.col("label").cast("long").alias("c")), "labels"))


def _pass(graph: DataFrame, resolution: float, seed: int, few: int, communities: DataFrame | None = None) -> DataFrame:
    spark = graph.sparkSession
    small, places, communities = shrunk(graph, resolution, seed, few, communities)
    if small.count() > max(few, FEW):  # nothing comes together any more: what is left are the communities
        ids = degrees(small).select(F.col("v").alias("c"))
        labels = places.select("node_id", F.col("v").alias("c")) if places is not None else ids.select(F.col("c").alias("node_id"), "c")
        return relabel(labels.withColumnRenamed("c", "label"))
    ids, i, j, w = _arrays(small)
    start = None
    if communities is not None:
        own = communities.toPandas().set_index("v")["c"]
        start = np.searchsorted(ids, own.loc[ids].to_numpy(np.int64))
    labels = _labelled(spark, ids, leiden_labels(len(ids), i, j, w, resolution, seed, start=start))
    return labels if places is None else places.join(labels.withColumnRenamed("node_id", "v"), "v").select("node_id", "label")


def ecg(edges: DataFrame, min_weight: float = 0.05, ensemble: int = 20, resolution: float = 1.0, seed: int = 0, few: int | None = None) -> DataFrame:
    """(node_id, label): edges are weighed by how often one level of moving puts their ends together,
    over an ensemble; the weighted graph is then clustered."""
    spark, graph, few = edges.sparkSession, both_ends(edges), FEW if few is None else few
    if graph.count() > few:
        near, needed, size = blocks(graph)
        runs = degrees(graph).select("v", "k", F.array_repeat("v", ensemble).alias("c"))
        nodes = moved_together(near, needed, size, written(runs, "runs"), resolution, seed)

        def weigh(near: pa.Table, known: pa.Table) -> pa.Table:
            known = known.sort_by("v")
            v, c = known["v"].to_numpy(), known["c"].combine_chunks().flatten().to_numpy().reshape(-1, ensemble)
            i, j, w = edges_of(near, v)
            together = sum(((c[i, r] == c[j, r]).astype(float) for r in range(ensemble)), np.zeros(len(w)))
            return pa.table({"i": v[i], "j": v[j], "w": w * (min_weight + (1 - min_weight) * together / ensemble)})

        weighted = met(near, needed, nodes.select("v", "c"), weigh, "i long, j long, w double")
        return _leiden(written(weighted.unionByName(graph.where("i = j")), "weighted"), resolution, seed, few)
    ids, i, j, w = _arrays(graph)
    n, together = len(ids), np.zeros(len(w))
    for r in range(ensemble):
        own = settled(n, i, j, w, resolution, np.random.default_rng(seed + r), np.arange(n))
        together += own[i] == own[j]
    return _labelled(spark, ids, leiden_labels(n, i, j, w * (min_weight + (1 - min_weight) * together / max(ensemble, 1)), resolution, seed))


def spectral(edges: DataFrame, k: int, seed: int = 0, few: int | None = None) -> DataFrame:
    """(node_id, label): a cut into at most ``k`` parts by the leading eigenvectors of the normalised
    graph, discretised by turning them (``spectrum``).  Edges must weigh more than 0 to count."""
    graph = both_ends(edges.where("weight > 0"))
    if graph.isEmpty():
        return graph.select(F.col("i").alias("node_id"), F.lit(0).alias("label"))
    rows, _ = spectrum.leading(graph, k, seed, FEW if few is None else few)
    labels = spectrum.discretised(rows).table(edges.sparkSession)
    return relabel(labels.select(F.col("v").alias("node_id"), F.get("x", F.lit(0)).cast("long").alias("label")))


def gaussian_mixture(df: DataFrame, vector: str, k: int, seed: int = 0, node_id: str = "node_id") -> DataFrame:
    """(node_id, label, probability array)."""
    from pyspark.ml.functions import vector_to_array

    packed = df.select(F.col(node_id).alias("node_id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    out = GaussianMixture(k=k, seed=seed).fit(packed).transform(packed)
    return out.select("node_id", F.col("prediction").alias("label"), vector_to_array("probability").alias("probability"))


def hdbscan(df: DataFrame, vector: str, min_cluster_size: float = 0.001, min_samples: int = 1, k: int = 15, noise_to_cluster: bool = False, metric: str = "euclidean", node_id: str = "node_id") -> DataFrame:
    """(node_id, label), -1 for noise: the most stable clusters of mutual reachability distances over
    all pairs of points.  A size below 1 is a share of all nodes; with ``noise_to_cluster`` noise takes
    the cluster of its nearest point that is in one.  ``k`` has no effect: the hierarchy is exact."""
    return density.hdbscan(df, vector, min_cluster_size, min_samples, noise_to_cluster, metric, node_id)


def cluster(df: DataFrame, vector: str, kind: str = "leiden", n_neighbors: int = 15, k_cluster: int = 15, metric: str = "euclidean", n_clusters: int | None = None, resolution: float = 1.0, min_cluster_size: float = 0.001, flavor: str | None = None, seed: int = 0, node_id: str = "node_id", edges: DataFrame | None = None, **options) -> tuple[DataFrame, int]:
    """(labels, number of clusters) by 'leiden', 'ecg', 'spectral', 'hdbscan' or 'gmm'.  The graph, ``edges``
    where it is there already, has no more neighbours than the embedding it comes from; the 'CellCharter'
    flavour is a mixture of ten."""
    if flavor == "CellCharter":
        kind, n_clusters = "gmm", n_clusters or 10
    elif flavor == "UTAG":
        raise NotImplementedError("the UTAG flavour isn't defined")
    k = min(k_cluster, n_neighbors)
    if kind in ("leiden", "ecg", "spectral"):
        edges = knn_edges(df, vector, k, metric, node_id) if edges is None else edges
        labels = leiden(edges, resolution, seed) if kind == "leiden" else ecg(edges, resolution=resolution, seed=seed, **options) if kind == "ecg" else spectral(edges, n_clusters or 10, seed)
    elif kind == "hdbscan":
        labels = hdbscan(df, vector, min_cluster_size, k=k, metric=metric, node_id=node_id, **options)
    elif kind == "gmm":
        labels = gaussian_mixture(df, vector, n_clusters or 10, seed, node_id).select("node_id", "label")
    else:
        raise ValueError("a clusterer is 'leiden', 'ecg', 'spectral', 'hdbscan' or 'gmm'")
    labels = labels.persist()
    return labels, labels.where("label >= 0").select("label").distinct().count()
