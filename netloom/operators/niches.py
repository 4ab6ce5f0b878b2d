"""Composition of niches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("total", "obs", "niche", "clr", "niche&obs", "counts")


def composition(df: DataFrame, var: str, niche: str, normalize: str = "total") -> DataFrame:
    """(var, niche, value) on the dense grid of both columns' values.  ``total`` divides by all rows,
    ``obs`` by the row's sum, ``niche`` by the column's, ``niche&obs`` by both in turn, ``clr`` takes
    centred log ratios; anything else leaves counts."""
    counts = df.groupBy(var, niche).agg(F.count(F.lit(1)).alias("n"))
    # The grid of distinct values of two label columns, each a short list.
    grid = counts.select(var).distinct().join(counts.select(niche).distinct())
    same = lambda c: F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}"))
    dense = grid.alias("g").join(counts.alias("c"), same(var) & same(niche), "left").select(f"g.{var}", f"g.{niche}", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    total = lambda t, *by: t.join(t.groupBy(*by).agg(F.sum("value").alias("_t")), [*by]).select(var, niche, (F.col("value") / F.nullif("_t", F.lit(0.0))).alias("value"))
    if normalize == "total":
        return dense.join(dense.agg(F.sum("value").alias("_t"))).select(var, niche, (F.col("value") / F.col("_t")).alias("value"))
    if normalize == "obs":
        return total(dense, var)
    if normalize == "niche":
        return total(dense, niche)
    if normalize == "niche&obs":
        return total(total(dense, var), niche)
    if normalize == "clr":
        logs = dense.join(dense.agg(F.max("value").alias("_m"))).withColumn("value", F.ln(F.when(F.col("value") == 0, F.col("_m") / F.lit(100000.0)).otherwise(F.col("value"))))
        means = logs.groupBy(var).agg(F.avg("value").alias("_a"))
        return logs.join(means, var).select(var, niche, (F.col("value") - F.col("_a")).alias("value"))
    return dense


def wide(long: DataFrame, var: str, niche: str, niches: Sequence) -> DataFrame:
    """One column per niche, the values given so that no job has to find them."""
    return long.groupBy(var).pivot(niche, list(niches)).agg(F.first("value"))


def histogram(df: DataFrame, niche: str) -> DataFrame:
    """(niche, n)."""
    return df.groupBy(niche).agg(F.count(F.lit(1)).alias("n"))


def survival_response(df: DataFrame, event: str, duration: str) -> DataFrame:
    """(event boolean, duration double) and nothing else."""
    return df.select((F.col(event).cast("int") != 0).alias("event"), F.col(duration).cast("double").alias("duration"))
