"""Dimension reduction."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import blocked, layout
from netloom.operators.graphs import knn
from netloom.sources.io import exists

#: Points of a layout that runs on the driver.
FEW = 50_000


def reducer_name(kind: str, **params) -> str:
    """A name that tells reducers and their parameters apart."""
    if kind not in ("umap", "pca", "none"):
        raise ValueError("a reducer is 'umap', 'pca' or 'none'")
    return ",".join([kind, *(f"{k}={v}" for k, v in sorted(params.items()) if v is not None)])


def assembled(df: DataFrame, columns: list[str], node_id: str = "node_id") -> DataFrame:
    """(node_id, vector) of numeric columns; rows with a null are left out."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in columns))
    return df.select(F.col(node_id).alias("node_id"), x.alias("vector")).where(~F.exists("vector", lambda v: v.isNull()))


def pca(df: DataFrame, columns: list[str], k: int = 2, scale: bool = True, keep: tuple[str, ...] = ("node_id",)) -> tuple[DataFrame, DataFrame]:
    """(scores, loadings): (keep, scores array) and (variable, loadings array) of ``k`` components of
    the standardised columns.  Each component's largest loading is positive."""
    packed = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns}))
    if scale:
        packed = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(packed).transform(packed)
    model = PCA(k=k, inputCol="_s" if scale else "_v", outputCol="_p").fit(packed)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), range(k)])
    signs = F.array(*(F.lit(float(s or 1)) for s in sign))
    scores = model.transform(packed).select(*keep, F.zip_with(vector_to_array("_p"), signs, lambda a, b: a * b).alias("scores"))
    rows = [(c, [float(v) for v in load[i] * sign]) for i, c in enumerate(columns)]
    return scores, df.sparkSession.createDataFrame(rows, "variable string, loadings array<double>")


def biplot(scores: DataFrame) -> DataFrame:
    """Scores of the first two components scaled by their ranges."""
    x, y = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    ranges = scores.agg(*((F.max(c) - F.min(c)).alias(n) for c, n in ((x, "_x"), (y, "_y"))))
    return scores.join(F.broadcast(ranges)).select(*(c for c in scores.columns if c != "scores"), (x / F.nullif("_x", F.lit(0.0))).alias("x"), (y / F.nullif("_y", F.lit(0.0))).alias("y"))


def umap(df: DataFrame, vector: str = "vector", n_components: int = 2, n_neighbors: int = 15, metric: str = "manhattan", min_dist: float = 0.0, epochs: int = 200, seed: int = 0, node_id: str = "node_id", few: int | None = None) -> DataFrame:
    """(node_id, embedding): a fuzzy kNN graph laid out by spectral initialisation and sampled
    gradient steps.  Layouts of at most ``few`` (``FEW``) nodes run on the driver, larger ones on the
    cluster (``layout``)."""
    graph = blocked.written(layout.fuzzy(knn(df, vector, n_neighbors, metric, node_id)), "fuzzy")
    few = FEW if few is None else few
    if graph.select("i").distinct().count() > few:
        return layout.spread(graph, n_components, min_dist, epochs, seed)
    graph = graph.toPandas().sort_values(["i", "j"])
    if not len(graph):
        return df.sparkSession.createDataFrame([], "node_id long, embedding array<double>")
    ids = np.unique(graph["i"].to_numpy())
    i, j, w = np.searchsorted(ids, graph["i"]), np.searchsorted(ids, graph["j"]), graph["w"].to_numpy()
    rng, n = np.random.default_rng(seed), len(ids)
    degree = np.sqrt(np.maximum(np.bincount(i, w, n), 1e-12))
    y = np.linalg.qr(rng.normal(size=(n, n_components + 1)))[0] if n > n_components else rng.normal(size=(n, n_components + 1))
    for _ in range(100):  # subspace iteration on the normalised graph
        z = y / degree[:, None]
        z = np.stack([np.bincount(i, w * z[j, c], n) for c in range(z.shape[1])], 1) / degree[:, None] + y
        y = np.linalg.qr(z)[0] if n > n_components else z
    y = y[:, 1:] / (np.abs(y[:, 1:]).max(initial=0) or 1) * 10 + rng.normal(scale=1e-4, size=(n, n_components))
    a, b = layout.curve(min_dist)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        on = rng.random(len(w)) < w / w.max()
        s, t = i[on], j[on]
        d = y[s] - y[t]
        q = (d * d).sum(1)
        pull = np.clip(-2 * a * b * np.maximum(q, 1e-12) ** (b - 1) / (1 + a * q**b) * (q > 0), -4, 0)[:, None] * d
        move = np.clip(pull, -4, 4)
        step = np.stack([np.bincount(s, move[:, c], n) - np.bincount(t, move[:, c], n) for c in range(n_components)], 1)
        for _ in range(5):
            r = rng.integers(0, n, len(s))
            d = y[s] - y[r]
            q = (d * d).sum(1)
            push = np.clip(2 * b / ((0.001 + q) * (1 + a * q**b))[:, None] * d, -4, 4) * (s != r)[:, None]
            step += np.stack([np.bincount(s, push[:, c], n) for c in range(n_components)], 1)
        y += rate * np.clip(step, -4, 4)
    rows = [(int(k), [float(v) for v in row]) for k, row in zip(ids, y, strict=True)]
    return df.sparkSession.createDataFrame(rows, "node_id long, embedding array<double>")


def fitted_pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """(variable, mean, scale, loadings): what a component analysis of standardised columns learns from
    rows without a null or NaN.  A column that doesn't vary has no say."""
    own = assembled(df, columns).where(~F.exists("vector", F.isnan))
    _, loadings = pca(own.select("node_id", *(F.get("vector", F.lit(i)).alias(f"c{i}") for i in range(len(columns)))), [f"c{i}" for i in range(len(columns))], k)
    at = lambda i: F.get("vector", F.lit(i))
    found = own.agg(*(f(at(i)).alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    load = {r["variable"]: r["loadings"] for r in loadings.collect()}
    rows = [(c, found[f"m{i}"], found[f"s{i}"] or 0.0, load[f"c{i}"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "variable string, mean double, scale double, loadings array<double>")


def projected(df: DataFrame, fitted: DataFrame, node_id: str = "node_id") -> DataFrame:
    """(node_id, embedding): rows projected by what ``fitted_pca`` learned."""
    rows = {r["variable"]: r for r in fitted.collect()}
    columns = list(rows)
    scaled = [(F.get("vector", F.lit(i)) - F.lit(rows[c]["mean"])) * F.lit(1 / rows[c]["scale"] if rows[c]["scale"] else 0.0) for i, c in enumerate(columns)]
    scores = [sum((x * F.lit(rows[c]["loadings"][j]) for x, c in zip(scaled, columns, strict=True)), F.lit(0.0)) for j in range(len(rows[columns[0]]["loadings"]))]
    return assembled(df, columns, node_id).where(~F.exists("vector", F.isnan)).select("node_id", F.array(*scores).alias("embedding"))


def _modelled(df: DataFrame, columns: list[str], kind: str, node_id: str, model: str, **options) -> DataFrame:
    """Applies the model saved at a path, or fits and saves it first."""
    spark, place = df.sparkSession, model.rstrip("/")
    wanted = [kind, *columns]
    if not exists(spark, f"{place}/settings/_SUCCESS"):
        own = assembled(df, columns, node_id)
        if kind == "umap":
            layout_ = umap(own, **options).join(own, "node_id").select("node_id", "vector", "embedding")
            layout_.write.mode("overwrite").parquet(f"{place}/fitted")
        elif kind == "pca":
            fitted_pca(df.withColumnRenamed(node_id, "node_id"), columns, options.get("n_components", 2)).write.mode("overwrite").parquet(f"{place}/fitted")
        settings = [(wanted, options.get("n_neighbors", 15), options.get("metric", "manhattan"))]
        spark.createDataFrame(settings, "reducer array<string>, n_neighbors int, metric string").write.mode("overwrite").parquet(f"{place}/settings")
        if kind == "umap":
            return spark.read.parquet(f"{place}/fitted").select("node_id", "embedding")
    settings = spark.read.parquet(f"{place}/settings").first()
    if settings["reducer"] != wanted:
        raise ValueError(f"the model at {model} is of {settings['reducer']}")
    if kind == "none":
        return assembled(df, columns, node_id).select("node_id", F.col("vector").alias("embedding"))
    fitted = spark.read.parquet(f"{place}/fitted")
    return projected(df, fitted, node_id) if kind == "pca" else layout.placed(fitted, assembled(df, columns, node_id), settings["n_neighbors"], settings["metric"])


def reduce(df: DataFrame, columns: list[str], kind: str = "umap", node_id: str = "node_id", model: str | None = None, **options) -> DataFrame:
    """(node_id, embedding) by 'umap', 'pca' or 'none'.  With ``model``, a path, what is learned is saved
    there once, and later calls apply it to other tables: they project by its components, or place
    nodes in its layout.  A finished model of another kind or of other columns raises."""
    if kind not in ("umap", "pca", "none"):
        raise ValueError("a reducer is 'umap', 'pca' or 'none'")
    if model is not None:
        return _modelled(df, columns, kind, node_id, model, **options)
    own = assembled(df, columns, node_id)
    if kind == "none":
        return own.select("node_id", F.col("vector").alias("embedding"))
    if kind == "pca":
        scores, _ = pca(df, columns, options.get("n_components", 2), keep=(node_id,))
        return scores.select(F.col(node_id).alias("node_id"), F.col("scores").alias("embedding"))
    return umap(own, **options)
