"""Entry points over a cohort on disk: from file pairs to statistics and features in one job.

Each reads all networks of a folder at once (``sources.io.read_files``), so there is no loop over
samples and no cluster to set up: networks are rows of the same plan, keyed by their ids.  With
``save`` the result is written once under its parameters and read back the next time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.model import KEYS, checked, class_sets, label_sets
from netloom.operators import assort, neighbors, preprocess
from netloom.sources import io


def read(spark: SparkSession, nodes_dir: str, edges_dir: str | None = None, levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder, or of one folder each.  Files without ``node_id`` number their
    rows from 0, as edges do; such files must not be split, which whole small files aren't."""
    nodes = io.read_files(spark, nodes_dir, "nodes", levels, extension, index)
    edges = io.read_files(spark, edges_dir or nodes_dir, "edges", levels, extension, index)
    if "node_id" not in nodes.columns:
        row = F.col("_metadata.row_index") if extension == "parquet" else None
        if row is None:
            raise ValueError("nodes in text files need a node_id column")
        nodes = io.read_files(spark, nodes_dir, "nodes", levels, extension, index, extra={"node_id": row})
    return nodes.withColumn("node_id", F.col("node_id").cast("long")), edges.select(*levels, F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))


def attribute_values(nodes: DataFrame, column: str) -> list:
    """The distinct values of a class column over the whole cohort, in order."""
    return sorted(r[0] for r in nodes.select(column).where(F.col(column).isNotNull()).distinct().collect())


def _kept(spark: SparkSession, save: str | None, name: str, params: dict, compute, recompute: bool) -> DataFrame:
    return compute() if save is None else io.cached(spark, io.keyed(save, name, params), compute, recompute)


def network_stats(spark: SparkSession, net_dir: str, attributes_col: str | Sequence[str], use_attributes: Sequence[str] | None = None, levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None, n_shuffle: int = assort.SHUFFLES, save: str | None = None, recompute: bool = False) -> DataFrame:
    """One wide row of assortativity statistics per network.  ``attributes_col`` is a class column or
    a list of 0/1 columns; attributes are those of the whole cohort, absent ones count 0."""

    def compute() -> DataFrame:
        nodes, edges = read(spark, net_dir, None, levels, extension, index)
        if isinstance(attributes_col, str):
            names = list(use_attributes or attribute_values(nodes, attributes_col))
            labels = class_sets(nodes, attributes_col, names, levels)
        else:
            names = list(use_attributes or attributes_col)
            labels = label_sets(nodes, names, levels)
        return assort.sample_stats(nodes, checked(nodes, edges, levels), names, levels, n_shuffle, labels)

    return _kept(spark, save, "stats", {"dir": net_dir, "col": attributes_col, "use": use_attributes, "levels": levels, "extension": extension, "index": index, "n": n_shuffle}, compute, recompute)


def spatial_features(spark: SparkSession, nodes_dir: str, attributes_col: str | Sequence[str], edges_dir: str | None = None, use_attributes: Sequence[str] | None = None, method: str = "NAS", order: int = 1, stats: Sequence[str] | str = ("mean", "std"), sep: str = " ", levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None, components: int = 30, save: str | None = None, recompute: bool = False) -> DataFrame:
    """A row of neighbourhood features per node of every network.  ``method`` is 'NAS' or 'smoothed'."""
    if method not in ("NAS", "smoothed"):
        raise ValueError("a method is 'NAS' or 'smoothed'")

    def compute() -> DataFrame:
        nodes, edges = read(spark, nodes_dir, edges_dir, levels, extension, index)
        if isinstance(attributes_col, str):
            names = list(use_attributes or attribute_values(nodes, attributes_col))
            nodes = nodes.withColumns({n: F.coalesce((F.col(attributes_col) == n).cast("double"), F.lit(0.0)) for n in names})
        else:
            names = list(use_attributes or attributes_col)
        edges = checked(nodes, edges, levels)
        return neighbors.nas(nodes, edges, names, order, stats, sep, levels) if method == "NAS" else neighbors.smoothed(nodes, edges, names, min(components, len(names)), levels)

    params = {"nodes": nodes_dir, "edges": edges_dir, "col": attributes_col, "use": use_attributes, "method": method, "order": order, "stats": stats, "sep": sep, "levels": levels, "extension": extension, "index": index, "components": components}
    return _kept(spark, save, "features", params, compute, recompute)


def aggregate_nodes(spark: SparkSession, nodes_dir: str, use_cols: Sequence[str] | None = None, add_info: bool = True, levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None) -> DataFrame:
    """The nodes of all networks as one table."""
    nodes = io.read_files(spark, nodes_dir, "nodes", levels, extension, index)
    names = [c for c in nodes.columns if c not in levels] if use_cols is None else list(use_cols)
    return nodes.select(*(F.col(f"`{c}`") for c in names), *(levels if add_info else ()))


def transform_nodes(spark: SparkSession, nodes_dir: str, use_cols: Sequence[str], method: str = "clr", levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None, save: str | None = None, recompute: bool = False) -> DataFrame:
    """The nodes with transformed columns; zeros are replaced by each network's own largest value."""
    compute = lambda: preprocess.transform(io.read_files(spark, nodes_dir, "nodes", levels, extension, index), use_cols, method, levels)
    return _kept(spark, save, f"transfo-{method}", {"dir": nodes_dir, "cols": list(use_cols), "levels": levels, "extension": extension, "index": index}, compute, recompute)


def batch_correct_nodes(spark: SparkSession, nodes_dir: str, use_cols: Sequence[str], batch_key: str = "patient", node_id: str = "node_id", max_dims: int = 100, levels: Sequence[str] = KEYS, extension: str = "parquet", index: Sequence[tuple] | None = None, save: str | None = None, recompute: bool = False) -> DataFrame:
    """The nodes with batch-corrected columns, the others as they were, each row under its own id."""
    compute = lambda: preprocess.batch_correct(io.read_files(spark, nodes_dir, "nodes", levels, extension, index), use_cols, batch_key, node_id, max_dims)
    return _kept(spark, save, "corrected", {"dir": nodes_dir, "cols": list(use_cols), "key": batch_key, "id": node_id, "dims": max_dims, "levels": levels, "extension": extension, "index": index}, compute, recompute)
