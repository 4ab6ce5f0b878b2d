"""Small networks with known answers, and random ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.ranks import hash_key

#: Fixed values: (labels in node order, edges, x, y) of the networks that known answers exist for.
NETWORKS = {
    "triangle": ("abc", [(0, 1), (1, 2), (2, 0)], [1, 3, 2], [2, 2, 1]),
    "trigonal": ("abcabc", [(0, 1), (1, 2), (2, 0), (0, 3), (1, 4), (2, 5)], [1, 3, 2, 0, 4, 2], [2, 2, 1, 3, 3, 0]),
    "p": ("acccbc", [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 2)], [0, 0, 0, 0, 1, 1], [0, 1, 2, 3, 3, 2]),
    "high": ("aaaabbbbcccc", [(i, i + 1) for b in (0, 4, 8) for i in range(b, b + 3)], list(range(12)), [0] * 12),
    "low": ("abc" * 4, [(i, (i + 1) % 12) for i in range(12)], [1, 2, 3, 4, 4, 4, 3, 2, 1, 0, 0, 0], [0, 0, 0, 1, 2, 3, 4, 4, 4, 3, 2, 1]),
}


def network(spark: SparkSession, name: str, patient: str = "0", sample: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a named network: coordinates, one-hot a, b, c, and keys."""
    labels, edges, x, y = NETWORKS[name]
    sample = name if sample is None else sample
    rows = [(patient, sample, i, float(x[i]), float(y[i]), *(int(c == k) for k in "abc")) for i, c in enumerate(labels)]
    nodes = spark.createDataFrame(rows, "patient string, sample string, node_id long, x double, y double, a int, b int, c int")
    return nodes, spark.createDataFrame([(patient, sample, s, t) for s, t in edges], "patient string, sample string, source long, target long")


def cohort(spark: SparkSession, names: Sequence[str] = ("high", "low")) -> tuple[DataFrame, DataFrame]:
    """Several networks as one cohort."""
    parts = [network(spark, n) for n in names]
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.union(n), edges.union(e)
    return nodes, edges


def random_network(spark: SparkSession, n: int = 100, p: float = 0.1, attributes: Sequence[str] = ("a", "b", "c"), multi: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """G(n, p) with coordinates on the unit circle and random labels: one class a node, or several.
    A draw is the first eight digits of an md5 of its name, so the network depends on its arguments
    only and any engine can repeat it."""
    u = lambda *c: F.conv(F.substring(hash_key(F.lit(seed), *c), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    ids = spark.range(n).select(F.col("id").alias("node_id"))
    angle = F.lit(2.0) * F.pi() * u(F.col("node_id"), F.lit("angle"))
    nodes = ids.select(F.lit("0").alias("patient"), F.lit("random").alias("sample"), "node_id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))
    if multi:
        nodes = nodes.withColumns({a: u(F.col("node_id"), F.lit(a)) < 0.5 for a in attributes})
    else:
        nodes = nodes.withColumn("nodes_class", F.element_at(F.array(*map(F.lit, attributes)), (F.floor(u(F.col("node_id"), F.lit("class")) * len(attributes)) + 1).cast("int")))
        nodes = nodes.withColumns({a: (F.col("nodes_class") == a).cast("int") for a in attributes})
    pairs = ids.select(F.col("node_id").alias("source")).withColumn("target", F.explode(F.sequence(F.col("source") + 1, F.greatest(F.col("source") + 1, F.lit(n - 1)))))
    edges = pairs.where((F.col("target") < n) & (u(F.col("source"), F.col("target")) < p))
    return nodes, edges.select(F.lit("0").alias("patient"), F.lit("random").alias("sample"), "source", "target")
