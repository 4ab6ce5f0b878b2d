"""The tables behind figures; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.clean import finite


def cluster_colors(labels: Sequence, grey: str = "end") -> dict:
    """A colour for each label in order: evenly spaced hues, of two shades beyond ten and three
    beyond twenty labels; the noise label -1 is grey, in first or last place."""
    import colorsys

    named = sorted({x for x in labels if x != -1})
    shades = 1 + (len(named) > 10) + (len(named) > 20)
    per = -(-len(named) // shades) if named else 1
    hexed = lambda i: "#" + "".join(f"{round(255 * v):02x}" for v in colorsys.hls_to_rgb((i % per) / per, 0.45 + 0.15 * (i // per), 0.65))
    out = {x: hexed(i) for i, x in enumerate(named)}
    if -1 in set(labels):
        out = {-1: "#b0b0b0", **out} if grey == "begin" else {**out, -1: "#b0b0b0"}
    return out


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("_t"))).select(label, "n", (F.col("n") / F.col("_t")).alias("share"))


def centroids(df: DataFrame, label: str, coords: Sequence[str]) -> DataFrame:
    """(label, n, mean coordinates) of each cluster."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in coords))


def distributions(df: DataFrame, group: str, columns: Sequence[str], groups: Sequence | None = None) -> DataFrame:
    """(group, variable, value): the finite values in long form."""
    rows = df if groups is None else df.where(F.col(group).isin(list(groups)))
    wide = rows.select(group, *(finite(c).alias(c) for c in columns))
    return wide.unpivot(group, [f"`{c}`" for c in columns], "variable", "value").where("value is not null")


def top_markers(pvals: DataFrame, n: int = -1, thresh: float = 0.05, col: str = "pval_corr") -> DataFrame:
    """The markers below the threshold, the ``n`` smallest of them."""
    below = pvals.where(F.col(col) < thresh).orderBy(col, "marker")
    return below.limit(n) if n >= 0 else below


def box_stats(long: DataFrame, group: str) -> DataFrame:
    """(group, variable, n, low, q1, median, q3, high)."""
    q = F.percentile("value", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    names = ("low", "q1", "median", "q3", "high")
    return long.groupBy(group, "variable").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).select(group, "variable", "n", *(F.get("q", F.lit(i)).alias(x) for i, x in enumerate(names)))


def z_scored(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), drop_unique: bool = True) -> DataFrame:
    """The columns as z-scores (population deviation); with ``drop_unique`` a column of one value is
    left out, else it is null."""
    stats = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("_m", F.avg), ("_s", F.stddev_pop))))
    if drop_unique:
        row = stats.first()
        columns = [c for i, c in enumerate(columns) if row[f"_s{i}"]]
        stats = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("_m", F.avg), ("_s", F.stddev_pop)))) if columns else stats
    z = [((F.col(f"`{c}`").cast("double") - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0))).alias(c) for i, c in enumerate(columns)]
    return df.join(F.broadcast(stats)).select(*keep, *z)


def linkage_order(z: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns in the order of average linkage of their correlations."""
    import itertools

    import numpy as np

    if len(columns) < 2:
        return list(columns)
    pairs = list(itertools.combinations(range(len(columns)), 2))
    row = z.agg(*(F.corr(F.col(f"`{columns[i]}`"), F.col(f"`{columns[j]}`")).alias(f"c{i}_{j}") for i, j in pairs)).first()
    d = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        d[i, j] = d[j, i] = 1 - (row[f"c{i}_{j}"] or 0.0)
    groups = [[i] for i in range(len(columns))]
    while len(groups) > 1:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: d[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] = groups[a] + groups.pop(b)
    return [columns[i] for i in groups[0]]


def color_below(value: Column, thresh: float = 0.05, color: str = "green", back: str = "white") -> Column:
    """A CSS declaration."""
    return F.when(value < thresh, f"background-color: {color}").otherwise(f"background-color: {back}")
