"""Screening of niche parameters: cluster, compose, join the outcome, fit, keep what predicts best."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators import cluster, niches, reduce, regress
from netloom.operators.blocked import written
from netloom.sources.io import cached, keyed

RESULT = T.StructType([
    T.StructField(n, t) for n, t in (
        ("reducer_type", T.StringType()), ("dim_clust", T.IntegerType()), ("n_neighbors", T.IntegerType()), ("metric", T.StringType()),
        ("clusterer_type", T.StringType()), ("k_cluster", T.IntegerType()), ("clust_size_param", T.DoubleType()), ("n_clusters", T.IntegerType()),
        ("normalize", T.StringType()), ("l1_ratio", T.DoubleType()), ("penalty", T.DoubleType()), ("n_coeffs", T.IntegerType()),
        ("score_roc_auc", T.DoubleType()), ("score_ap", T.DoubleType()), ("score_mcc", T.DoubleType()), ("score", T.DoubleType()),
    )
])
SIZE_OF = {"leiden": "resolution", "ecg": "ensemble", "spectral": "n_clusters", "gmm": "n_clusters", "hdbscan": "min_cluster_size"}
#: Clusterers of a neighbour graph.
GRAPHS = ("leiden", "ecg", "spectral")
#: The whole grid.
DIMS, NEIGHBORS, METRICS = (2, 3, 4, 5), (15, 45, 75, 100, 200), ("manhattan", "euclidean", "cosine")
SIZES = {"hdbscan": (50, 200), "spectral": tuple(range(3, 20)), "ecg": (5, 10, 15, 20), "leiden": (0.1, 0.03, 0.01, 0.003, 0.001), "gmm": tuple(range(3, 20))}
NORMALIZE = ("total", "niche", "obs", "clr", "niche&obs")
LOGISTIC = {"c_values": tuple(np.logspace(-4, 4, 20)), "l1_ratios": (*(i / 20 for i in range(21)), 0.99)}
#: Subjects whose models are fitted in tasks, a table of them in each; more are fitted by Spark's own.
SUBJECTS = 10_000


def grid(reducers: Sequence[str] = ("umap",), dims: Sequence[int] = DIMS, neighbors: Sequence[int] = NEIGHBORS, metrics: Sequence[str] = METRICS, k_clusters: Sequence[int] | None = None, sizes: Mapping[str, Sequence[float]] = SIZES, normalize: Sequence[str] = NORMALIZE) -> list[dict]:
    """All settings, by default 8,100 clusterings with five normalisations each; a graph never has more
    neighbours than the embedding."""
    return [
        {"reducer_type": r, "dim_clust": d, "n_neighbors": n, "metric": m, "k_cluster": k, "clusterer_type": c, "clust_size_param": float(s), "normalize": z}
        for r, d, n, m, k, c in product(reducers, dims, neighbors, metrics, neighbors if k_clusters is None else k_clusters, sizes)
        if k <= n
        for s, z in product(sizes[c], normalize)
    ]


def features(nodes: DataFrame, labels: DataFrame, predict_key: str, normalize: str) -> tuple[DataFrame, list[str]]:
    """One row per subject with its share of every niche."""
    # Labels of all nodes are merged, not sent through the driver.
    own = nodes.select("node_id", F.col(predict_key).alias("key")).join(labels.hint("merge"), "node_id")
    found = sorted(r["label"] for r in own.select("label").distinct().collect())
    wide = niches.wide(niches.composition(own, "key", "label", normalize), "key", "label", found)
    return wide.select("key", *(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"niche_{n}") for n in found)), [f"niche_{n}" for n in found]


def compared(nodes: DataFrame, labels: DataFrame, status: DataFrame, normalize: Sequence[str], predict_key: str, y: str, covariates: Sequence[str], options: Mapping) -> dict[str, dict]:
    """The scores of each normalisation of one clustering, one table of subjects a task."""
    own = written(nodes.select("node_id", F.col(predict_key).alias("key")).join(labels.hint("merge"), "node_id").select("key", "label"), "niches")
    each = [niches.composition(own, "key", "label", z).select(F.lit(z).alias("normalize"), "key", "label", F.coalesce("value", F.lit(0.0)).alias("value")) for z in normalize]
    long = each[0]
    for e in each[1:]:
        long = long.unionByName(e)
    values = F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda v: v["value"])
    x = F.concat(F.col("values"), F.array(*(F.col(f"`{c}`").cast("double") for c in covariates)).cast("array<double>"))
    tables = status.join(long.groupBy("normalize", "key").agg(values.alias("values")), "key").select("normalize", "key", F.col(f"`{y}`").alias("y"), x.alias("values"))
    return {r["normalize"]: r.asDict() for r in regress.logistic_tables(tables, "normalize", "y", "values", "key", **options).collect()}


def screen(nodes: DataFrame, columns: Sequence[str], status: DataFrame, settings: Sequence[dict], folder: str, predict_key: str = "sample", pred_type: str = "binary", y: str = "y", duration: str = "duration", event: str = "event", covariates: Sequence[str] = (), clusters: tuple[int, int] = (2, 200), recompute: bool = False, logistic: Mapping | None = None, cox: Mapping | None = None) -> DataFrame:
    """A row of scores for each setting.  ``status`` has the subject in ``key``.

    Embeddings, graphs and labels are kept below ``folder`` under their own parameters, and so are the
    rows of each clustering's settings: a run that stops is taken up with the missing ones only.
    Settings with too few or too many clusters get a row without scores.
    """
    spark, paths, parts = nodes.sparkSession, [], {}
    few = pred_type == "binary" and status.count() <= SUBJECTS
    for s in settings:
        # Mixtures and density clusters take no graph, so they are the same for all its neighbours.
        pre = {k: s[k] for k in ("reducer_type", "dim_clust", "n_neighbors", "metric")}
        part = pre | {k: s[k] for k in ("clusterer_type", "clust_size_param")} | ({"k_cluster": min(s["k_cluster"], s["n_neighbors"])} if s["clusterer_type"] in GRAPHS else {})
        parts.setdefault(keyed(folder, "labels", part), (pre, part, []))[2].append(s)
    fresh: set[str] = set()

    def once(path: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """Computed once in this call if all are to be computed anew."""
        again = recompute and path not in fresh
        fresh.add(path)
        return cached(spark, path, compute, again)

    for place, (pre, part, own) in parts.items():

        def embedded(pre: dict = pre) -> DataFrame:
            own = {"umap": {"n_components": pre["dim_clust"], "n_neighbors": pre["n_neighbors"], "metric": pre["metric"]}, "pca": {"n_components": pre["dim_clust"]}}
            return reduce.reduce(nodes, list(columns), pre["reducer_type"], **own.get(pre["reducer_type"], {}))

        def labelled(held: list, pre: dict = pre, part: dict = part) -> DataFrame:
            points = once(keyed(folder, "embedding", pre), lambda: embedded(pre))
            kind, size = part["clusterer_type"], part["clust_size_param"]
            options = {SIZE_OF[kind]: int(size) if SIZE_OF[kind] in ("n_clusters", "ensemble") else size}
            if kind in GRAPHS:
                options["edges"] = once(keyed(folder, "edges", pre | {"k_cluster": part["k_cluster"]}), lambda: cluster.knn_edges(points, "embedding", part["k_cluster"]))
            held.append(cluster.cluster(points, "embedding", kind, **options)[0])
            return held[0]

        def scored(own: list = own, place: str = place, labelled: Callable = labelled) -> DataFrame:
            held, rows = [], []
            labels = once(place, lambda: labelled(held))
            for h in held:
                h.unpersist()
            n = labels.where("label >= 0").select("label").distinct().count()
            good, scores = clusters[0] <= n < clusters[1], {}
            if good and few:
                scores = compared(nodes, labels, status, sorted({s["normalize"] for s in own}), predict_key, y, covariates, LOGISTIC | dict(logistic or {}))
            for z in {s["normalize"] for s in own} if good and not few else ():
                table, names = features(nodes, labels, predict_key, z)
                joined, names = status.join(table, "key"), [*names, *covariates]
                if pred_type == "binary":
                    fit = regress.logistic(joined, y, names, "key", **(LOGISTIC | dict(logistic or {})))
                    score = fit["scores"].first()
                    scores[z] = {"l1_ratio": fit["params"]["l1_ratio"], "penalty": fit["params"]["C"], "n_coeffs": int(fit["model"].coefficients.numNonzeros()), "score_roc_auc": score["auc"], "score_ap": score["ap"], "score_mcc": score["mcc"]}
                else:
                    fit = regress.cox(joined, duration, event, names, "key", **(cox or {}))
                    scores[z] = {"l1_ratio": fit["params"]["l1_ratio"], "penalty": fit["params"]["alpha"], "n_coeffs": fit["coef"].where("coef <> 0").count(), "score": fit["score"]}
            for s in own:
                row = s | {"n_clusters": n} | scores.get(s["normalize"], {})
                rows.append(tuple(row.get(f.name) for f in RESULT))
            return spark.createDataFrame(rows, RESULT).coalesce(1)

        paths.append(keyed(folder, "score", {"settings": own, "key": predict_key, "type": pred_type}))
        once(paths[-1], scored)
    return spark.read.schema(RESULT).parquet(*paths) if paths else spark.createDataFrame([], RESULT)
