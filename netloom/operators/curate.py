"""Relabelling and merging of clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import blocked

#: Points of a block; blocks of a side that share a key, at most.
SLICE, GROUP = 4096, 64


def relabel(df: DataFrame, label: str = "label", out: str = "label") -> DataFrame:
    """Labels 0..N-1 in the order of the old ones, always dense.  Ranks are made on distinct labels."""
    ids = df.select(F.col(label).alias("_old")).distinct().withColumn("_new", F.row_number().over(Window.orderBy(F.col("_old").asc_nulls_last())) - 1)
    met = df.join(ids, F.col(label).eqNullSafe(F.col("_old"))).drop("_old")
    return met.drop(out).withColumnRenamed("_new", out) if out == label else met.withColumnRenamed("_new", out)


def smallest(df: DataFrame, label: str = "label", size_thresh: float | None = None, size_perc: float = 25, ratio: float = 0.1) -> DataFrame:
    """(label, n, threshold): the smallest cluster (of equals the lowest label) and the size below
    which it merges: ``ratio`` times the percentile of sizes."""
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    thresh = F.lit(float(size_thresh)) if size_thresh is not None else F.percentile("n", F.lit(size_perc / 100)) * F.lit(ratio)
    least = sizes.agg(F.min_by(F.struct("label", "n"), F.struct("n", "label")).alias("s"), thresh.alias("threshold"), F.count(F.lit(1)).alias("clusters"))
    return least.select("s.label", "s.n", "threshold", "clusters")


def _packed(df: DataFrame, coords: Sequence[str], label: str) -> DataFrame:
    """(block, x, lab): points in blocks of SLICE at most."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for frame in frames:
            for i in range(0, len(frame), SLICE):
                part, block = frame.iloc[i : i + SLICE], block + 1
                yield pd.DataFrame({"block": [block], "x": [part[list(coords)].to_numpy(float).tobytes()], "lab": [part[label].to_numpy(np.int64).tobytes()]})

    return df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in coords), F.col(label).cast("long").alias(label)).mapInPandas(pack, "block long, x binary, lab binary")


def _closest(df: DataFrame, coords: Sequence[str], label: str, own: DataFrame) -> DataFrame:
    """(p, d, other): the nearest outside point of each point in ``own``, p being its coordinates.
    Groups of blocks of the small cluster meet groups of the others' blocks, each two under one key and
    small enough to keep all tasks busy; neither side is collected."""
    inside, outside = (blocked.written(_packed(d, coords, label), "sides") for d in (own, df))
    counts = inside.count(), outside.count()
    tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(GROUP, int((counts[0] * counts[1] / tasks) ** 0.5)))
    g, h = (max(1, -(-n // size)) for n in counts)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    inside = inside.select("block", F.col("x").alias("own"), F.pmod(F.xxhash64("block"), F.lit(g)).alias("g"), every(h).alias("h"))
    outside = outside.select("x", "lab", every(g).alias("g"), F.pmod(F.xxhash64("block"), F.lit(h)).alias("h"))
    pairs = inside.join(outside, ["g", "h"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, own, x, lab in zip(frame["block"], frame["own"], frame["x"], frame["lab"], strict=True):
                a, b, who = (np.frombuffer(v, t).reshape(-1, n) for v, t, n in ((own, float, len(coords)), (x, float, len(coords)), (lab, np.int64, 1)))
                for i in range(0, len(a), 512):
                    part = a[i : i + 512]
                    d = ((part[:, None, :] - b[None]) ** 2).sum(2) if len(coords) <= 4 else np.maximum((part**2).sum(1)[:, None] + (b**2).sum(1) - 2 * part @ b.T, 0)
                    least = d.min(1)
                    # Of equally near points the one with the lowest label.
                    other = np.where(d == least[:, None], who[:, 0], np.iinfo(np.int64).max).min(1)
                    yield pd.DataFrame({"p": [p.tobytes() for p in part], "block": block, "place": np.arange(i, i + len(part)), "d": least, "other": other})

    # Points alike in their coordinates are told apart by their place.
    found = pairs.select("block", "own", "x", "lab").mapInPandas(search, "p binary, block long, place long, d double, other long")
    return found.groupBy("p", "block", "place").agg(F.min(F.struct("d", "other")).alias("m")).select("p", "block", "place", "m.d", "m.other")


def _move(df: DataFrame, coords: Sequence[str], label: str, size_thresh: float | None = None, size_perc: float = 25, ratio: float = 0.1, n_neigh_max: int = 10, force: bool = False) -> tuple[int, int] | None:
    """The smallest cluster and the one it joins; None where it stays."""
    least = smallest(df, label, size_thresh, size_perc, ratio).first()
    if least is None or least["clusters"] <= 1 or not (force or least["n"] < least["threshold"]):
        return None
    mine = F.col(label) == least["label"]
    near = _closest(df.where(~mine), coords, label, df.where(mine))
    votes = near.orderBy("d", "p", "block", "place").limit(min(n_neigh_max, least["n"])).groupBy("other").agg(F.count(F.lit(1)).alias("v"))
    return least["label"], votes.orderBy(F.col("v").desc(), "other").first()["other"]


def _renamed(df: DataFrame, label: str, names: dict[int, int]) -> DataFrame:
    """Labels under the names of the clusters that took them in; a row a merged cluster."""
    if not names:
        return df
    kind = df.schema[label].dataType
    pairs = F.create_map(*(F.lit(v).cast(kind) for pair in names.items() for v in pair))
    return df.withColumn(label, F.coalesce(F.try_element_at(pairs, F.col(label)), F.col(label)))


def merge_smallest(df: DataFrame, coords: Sequence[str], label: str = "label", size_thresh: float | None = None, size_perc: float = 25, ratio: float = 0.1, n_neigh_max: int = 10, force: bool = False) -> tuple[DataFrame, bool]:
    """(labels, merged): the smallest cluster joins the one that most of its ``n_neigh_max`` closest
    outside neighbours belong to (of equals the lowest label), if it is small enough or forced.

    Neighbours that are equally near count in the order of their points' coordinates.
    """
    move = _move(df, coords, label, size_thresh, size_perc, ratio, n_neigh_max, force)
    return (df, False) if move is None else (_renamed(df, label, dict([move])), True)


def merge_until(df: DataFrame, coords: Sequence[str], label: str = "label", at_most: int | None = None, force: bool = False, relabelled: bool = True, **options) -> DataFrame:
    """Merge until nothing is small enough, or ``at_most`` clusters are left.

    The points are written once and stay as they are: a merge only adds to the names of clusters,
    so plans don't grow with the number of merges.
    """
    if force and at_most is None:
        raise ValueError("forced merging needs a number of clusters to stop at")
    own, names = blocked.written(df, "points"), {}
    while True:
        now = _renamed(own, label, names)
        move = _move(now, coords, label, force=force, **options)
        if move is not None:
            names = {**{a: move[1] if b == move[0] else b for a, b in names.items()}, move[0]: move[1]}
            now = _renamed(own, label, names)
        if move is None or (at_most is not None and now.select(label).distinct().count() <= at_most):
            return relabel(now, label) if relabelled else now
