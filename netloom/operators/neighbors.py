"""Neighbourhoods of up to k hops and statistics over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.model import KEYS

#: Statistics by name; a user function over a column gives a grouped pandas UDF by itself.
STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "count": F.count, "var": F.var_pop,
}


def one_hop(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, m): every edge from both sides, repeated edges repeated."""
    ends = F.array(F.struct(F.col("source").alias("n"), F.col("target").alias("m")), F.struct(F.col("target").alias("n"), F.col("source").alias("m")))
    return edges.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.n", "e.m")


def k_hop(nodes: DataFrame, edges: DataFrame, order: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, m, hop): every node m within ``order`` hops of n and its distance; n itself at 0.
    A step refers to the pairs found so far once, so a plan has ``order`` joins: rows of the newest
    level meet their neighbours and themselves, older ones pass by, and the smallest hop stays."""
    each = one_hop(edges, keys).distinct()
    every = nodes.select(*keys, F.col("node_id").alias("n"), F.col("node_id").alias("m"))
    step = each.unionByName(every).select(*keys, F.col("n").alias("via"), F.col("m").alias("to"), F.lit(True).alias("newest"))
    found = nodes.select(*keys, F.col("node_id").alias("n"), F.col("node_id").alias("m")).withColumn("hop", F.lit(0))
    for hop in range(1, order + 1):
        met = found.select(*keys, "n", F.col("m").alias("via"), "hop", (F.col("hop") == hop - 1).alias("newest")).join(step, [*keys, "via", "newest"], "left")
        stays = F.col("to").isNull() | (F.col("to") == F.col("via"))
        met = met.select(*keys, "n", F.coalesce("to", "via").alias("m"), F.when(stays, F.col("hop")).otherwise(hop).alias("hop"))
        found = met.groupBy(*keys, "n", "m").agg(F.min("hop").alias("hop"))
    return found


def nas(nodes: DataFrame, edges: DataFrame, attributes: Sequence[str], order: int = 1, stats: Sequence[str] | str | Mapping[str, Callable[[Column], Column]] = ("mean", "std"), sep: str = " ", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node_id, "{attribute}{sep}{stat}", ...): statistics over each node and its neighbours
    within ``order`` hops, statistic by statistic.  ``std`` is the population's; attributes a table
    lacks are 0; ``stats`` may be a name like "mean-max" or functions by name."""
    named = stats if isinstance(stats, Mapping) else {s: STATS[s] for s in (stats.split("-") if isinstance(stats, str) else stats)}
    have = set(nodes.columns)
    values = nodes.select(*keys, F.col("node_id").alias("m"), *((F.col(f"`{a}`") if a in have else F.lit(0)).cast("double").alias(f"_v{i}") for i, a in enumerate(attributes)))
    around = k_hop(nodes, edges, order, keys).select(*keys, "n", "m").join(values, [*keys, "m"])
    wanted = [f(F.col(f"_v{i}")).alias(f"{a}{sep}{s}") for s, f in named.items() for i, a in enumerate(attributes)]
    return around.groupBy(*keys, "n").agg(*wanted).withColumnRenamed("n", "node_id")


#: The same operation under the name of its older twin.
aggregate_k_neighbors = nas


def smoothed(nodes: DataFrame, edges: DataFrame, attributes: Sequence[str], k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node_id, features): a graph-smoothed PCA embedding: neighbourhood means, then the
    first ``k`` principal components.  It stands in for learnt spatial embeddings and isn't one."""
    from pyspark.ml.feature import PCA, VectorAssembler

    means = nas(nodes, edges, attributes, 1, ("mean",), "_", keys)
    packed = VectorAssembler(inputCols=[f"{a}_mean" for a in attributes], outputCol="_v").transform(means)
    return PCA(k=k, inputCol="_v", outputCol="features").fit(packed).transform(packed).select(*keys, "node_id", "features")


def stagate(*_, **__):
    """Not computed: there is no definition to compute."""
    raise NotImplementedError("STAGATE features aren't defined")


def hmrf_niches(*_, **__):
    """Not computed: there is no definition to compute."""
    raise NotImplementedError("HMRF niches aren't defined")
