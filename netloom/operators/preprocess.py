"""Rescaling, compositional transforms, aggregation of samples, batch correction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.model import KEYS
from netloom.operators import across, blocked


#: Groups whose largest values are sent to all tasks.
GROUPS = 100_000


def rescale(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Each column moved to low..high by its own extremes; null where a column is constant."""
    extremes = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"_{k}_{i}") for i, c in enumerate(columns) for k, f in (("min", F.min), ("max", F.max))))
    # One row meets all others.
    both = df.join(F.broadcast(extremes))
    span = lambda i: F.nullif(F.col(f"_max_{i}") - F.col(f"_min_{i}"), F.lit(0.0))
    new = {c: (F.col(f"`{c}`").cast("double") - F.col(f"_min_{i}")) / span(i) * F.lit(high - low) + F.lit(float(low)) for i, c in enumerate(columns)}
    return both.withColumns(new).select(*(F.col(f"`{c}`") for c in df.columns))


def _clr(values: list[Column], most: Column) -> list[Column]:
    """ln x less the row's mean of it; zeros become ``most`` / 100000.  Closing rows to 1 cancels out."""
    logs = [F.ln(F.when(v == 0, most / F.lit(100000.0)).otherwise(v)) for v in values]
    mean = reduce(Column.__add__, logs) / F.lit(float(len(logs)))
    return [x - mean for x in logs]


def transform(df: DataFrame, columns: Sequence[str], method: str = "clr", groups: Sequence[str] = ()) -> DataFrame:
    """``clr`` or ``logp1`` of the columns, in place.  Zeros are replaced by the largest value of
    the whole table, or of the row's group, over 100000."""
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    if method == "logp1":
        return df.withColumns({c: F.log1p(v) for c, v in zip(columns, values, strict=True)})
    if method != "clr":
        raise ValueError("method must be 'clr' or 'logp1'")
    row_max = F.greatest(*values) if len(values) > 1 else values[0]
    if groups:
        most = blocked.written(df.groupBy(*groups).agg(F.max(row_max).alias("_most")), "most")
        # A few large groups would leave most tasks of a shuffle without rows.
        df = df.join(F.broadcast(most) if most.count() <= GROUPS else most.hint("merge"), [*groups])
    else:
        df = df.join(F.broadcast(df.agg(F.max(row_max).alias("_most"))))
    names = [c for c in df.columns if c != "_most"]
    return df.withColumns(dict(zip(columns, _clr(values, F.col("_most")), strict=True))).select(*(F.col(f"`{c}`") for c in names))


def aggregate(samples: Sequence[DataFrame], columns: Sequence[str] | None = None, info: Sequence[str] = KEYS) -> DataFrame:
    """Union of samples by column name; columns a sample lacks are null."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), samples)
    return whole if columns is None else whole.select(*columns, *info)


# ---- batch correction ----------------------------------------------------------------------------

#: Neighbours that are matched; rounds; the matched share of a batch from which two are merged.
NEAREST, ROUNDS, LEAST = 20, 4, 0.1


def _principal(points: DataFrame, dims: int) -> np.ndarray | None:
    """Principal axes of the vectors, as columns; None where all components are kept, as turning
    changes no distance."""
    if dims >= points.select(F.size("v")).first()[0]:
        return None
    return PCA(k=dims, inputCol="x").fit(points.select(array_to_vector("v").alias("x"))).pc.toArray()


def mutual_matches(points: DataFrame, k: int = NEAREST, axes: np.ndarray | None = None) -> DataFrame:
    """(src, dst, here, there), written, from both ends: points (id, batch, v) of different batches,
    each among the other's ``k`` nearest of all other batches."""
    dim = points.select(F.size("v")).first()[0] if axes is None else axes.shape[1]
    if dim < blocked.PRODUCTS:
        found = across.nearest_others(across.leaves(points.withColumnRenamed("batch", "side"), k, axes), k)
    else:
        asked = points.select(F.lit(0).cast("long").alias("grp"), F.col("batch").alias("side"), F.lit(True).alias("ask"), "id", "v", F.lit(None).cast("array<double>").alias("w"))
        found = across.nearest(across.packed(asked, axes), k)
    near = blocked.written(found.select("src", "dst", "here", "there"), "near")
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return blocked.written(near.join(back, ["src", "dst"]), "matches")


def alignment(matches: DataFrame, sizes: dict[int, int]) -> dict[tuple[int, int], float]:
    """The score of each two batches (i < j) that match: the larger of their shares of matched points."""
    ends = matches.groupBy("here", "there").agg(F.countDistinct("src").alias("n"))
    scores: dict[tuple[int, int], float] = {}
    for r in ends.collect():
        pair = (min(r["here"], r["there"]), max(r["here"], r["there"]))
        scores[pair] = max(scores.get(pair, 0.0), r["n"] / sizes[r["here"]])
    return scores


def merges(scores: dict[tuple[int, int], float], part: dict[int, int], sizes: dict[int, int]) -> dict[int, int]:
    """Which part (a batch's part is ``part[batch]``) moves onto which: each part prefers the one that
    aligns best with it, so parts form trees; every other level moves onto its parents, at once."""
    best: dict[tuple[int, int], float] = {}
    for (i, j), s in scores.items():
        if part[i] != part[j]:
            pair = (min(part[i], part[j]), max(part[i], part[j]))
            best[pair] = max(best.get(pair, 0.0), s)
    weight: dict[int, int] = {}
    for b, p in part.items():
        weight[p] = weight.get(p, 0) + sizes[b]
    chosen: dict[int, tuple] = {}
    for pair in best:
        # A strict order of the pairs, so that choices form no cycle longer than two.
        key = (-best[pair], pair)
        for p in pair:
            chosen[p] = min(chosen.get(p, key), key)
    parent = {p: sum(key[1]) - p for p, key in chosen.items()}
    for p in list(parent):
        q = parent.get(p)
        if q is not None and parent.get(q) == p:
            del parent[min(p, q, key=lambda v: (-weight[v], v))]

    def depth(p: int) -> int:
        steps = 0
        while p in parent:
            p, steps = parent[p], steps + 1
        return steps

    odd = {p: depth(p) % 2 for p in parent}
    level = 1 if 2 * sum(odd.values()) >= len(odd) else 0
    return {p: parent[p] for p in parent if odd[p] == level}


def _moved(points: DataFrame, matches: DataFrame, part: dict[int, int], moves: dict[int, int], dim: int) -> DataFrame:
    """The points after all parts in ``moves`` went along their smoothed vectors of matches; written."""
    spark = points.sparkSession
    # A row a batch.
    parts = spark.createDataFrame([(b, p, moves.get(p)) for b, p in part.items()], "batch long, part long, onto long")
    here = parts.select(F.col("batch").alias("here"), F.col("part").alias("grp"), "onto").where("onto is not null")
    there = parts.select(F.col("batch").alias("there"), F.col("part").alias("onto"))
    used = matches.join(here, "here").join(there, ["there", "onto"])
    at = points.select(F.col("id").alias("src"), F.col("v").alias("p"))
    to = points.select(F.col("id").alias("dst"), F.col("v").alias("q"))
    vectors = used.join(to, "dst").join(at, "src").select("grp", "src", "dst", "p", F.zip_with("q", "p", lambda q, p: q - p).alias("u"))
    # At most NEAREST a point, summed in the order of their ids.
    gathered = vectors.groupBy("grp", "src").agg(F.first("p").alias("v"), F.sort_array(F.collect_list(F.struct("dst", "u"))).alias("all"))
    total = F.aggregate("all", F.array_repeat(F.lit(0.0), dim), lambda s, e: F.zip_with(s, e["u"], lambda a, b: a + b))
    sources = blocked.written(gathered.select("grp", F.lit(1).cast("long").alias("side"), F.lit(False).alias("ask"), F.col("src").alias("id"), "v", F.concat(total, F.array(F.size("all").cast("double"))).alias("w")), "sources")
    spread = reduce(Column.__add__, (F.var_pop(F.get("v", F.lit(j))) for j in range(dim)))
    widths = {r["grp"]: r["s"] + 1e-12 for r in sources.groupBy("grp").agg(spread.alias("s")).collect()}
    asked = points.join(parts.where("onto is not null"), "batch").select(F.col("part").alias("grp"), F.lit(0).cast("long").alias("side"), F.lit(True).alias("ask"), "id", "v", F.lit(None).cast("array<double>").alias("w"))
    shift = across.kernel_means(across.packed(asked.unionByName(sources)), widths, dim)
    moved = F.when(F.col("move").isNull(), F.col("v")).otherwise(F.zip_with("v", "move", lambda a, b: a + b))
    return blocked.written(points.join(shift, "id", "left").select("id", "batch", moved.alias("v")), "moved")


def batch_correct(df: DataFrame, columns: Sequence[str], batch: str = "patient", node_id: str = "node_id", max_dims: int = 100, k: int = NEAREST, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """The columns without batch effects.  Batches whose points are mutually nearest neighbours are
    merged in the order of their alignment, each moved along the vectors between matches, smoothed
    by a Gaussian as wide as the matched points are spread.

    All points are searched, matched and moved on the cluster, by pairs of blocks (``across``).  Matches
    across a gap are the closest points and understate it, so all is repeated ``rounds`` times.  The
    driver holds a number a batch and a score each two batches that match.  Batches that share fewer
    than ``least`` of their points with any other stay, as do rows without a batch or with a null or
    non-finite value.
    """
    if not columns:
        raise ValueError("no columns to correct")
    names = [*df.columns]
    row, vector, code = (next(n for n in (f"{'_' * i}{stem}" for i in range(1, len(names) + 2)) if n not in names) for stem in ("row", "vector", "code"))
    doubled = df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns}).withColumn(vector, F.array(*(F.col(f"`{c}`").cast("double") for c in columns)))
    # Rows are numbered in an order of their own, whatever partitions they came in, and kept so.
    order = [F.col(f"`{node_id}`"), F.col(f"`{batch}`"), F.col(vector)]
    rows = blocked.written(doubled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "rows")
    whole = ~F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.col(f"`{batch}`").isNotNull()
    fit = rows.where(whole)
    counts = fit.groupBy(F.col(f"`{batch}`").alias("_b")).count()
    # A row a batch.
    codes = blocked.written(counts.withColumn(code, F.row_number().over(Window.orderBy(F.desc("count"), F.col("_b").cast("string"))).cast("long")), "batches")
    sizes = {r[code]: r["count"] for r in codes.collect()}
    if len(sizes) < 2:
        return rows.select(*(F.col(f"`{c}`") for c in names))
    points = blocked.written(fit.join(codes, F.col(f"`{batch}`") == F.col("_b")).select(F.col(row).alias("id"), F.col(code).alias("batch"), F.col(vector).alias("v")), "points")
    axes = _principal(points, max_dims)
    for _ in range(rounds):
        matches = mutual_matches(points, k, axes)
        scores = {pair: s for pair, s in alignment(matches, sizes).items() if s >= least}
        part = {b: b for b in sizes}
        while moves := merges(scores, part, sizes):
            points = _moved(points, matches, part, moves, len(columns))
            part = {b: moves.get(p, p) for b, p in part.items()}
        if len(set(part.values())) == len(part):
            break
    fixed = points.select(F.col("id").alias(row), F.col("v").alias(code))
    new = {c: F.coalesce(F.get(code, F.lit(i)), F.col(f"`{c}`")) for i, c in enumerate(columns)}
    return rows.join(fixed, row, "left").withColumns(new).select(*(F.col(f"`{c}`") for c in names))
