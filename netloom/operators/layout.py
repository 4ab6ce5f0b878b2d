"""Layouts of neighbour graphs by fuzzy membership and sampled gradient steps, of any size.

On the cluster an epoch is two joins: the edges that are drawn meet the places of both their ends, and
a node adds up its own pulls.  A node's pushes come from nodes drawn out of a fresh pool of ``POOL``
others each epoch; every node is drawn as likely.  Layouts of few nodes run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from netloom.operators import across, spectrum
from netloom.operators.blocked import vectors, written

#: Nodes of an epoch's pool; pushes for each drawn edge.
POOL, PUSHES = 4096, 5
#: Pushes computed at once.
SLAB = 1 << 19


def memberships(distance: np.ndarray) -> np.ndarray:
    """Weights of each row's distances, padded by infinity: 1 up to the nearest that isn't 0, then
    falling exponentially, so that a row of k sums to log2 k."""
    some = np.isfinite(distance)
    near = np.where(some & (distance > 0), distance, np.inf).min(1, initial=np.inf)
    far = np.where(some, np.maximum(distance - np.where(np.isfinite(near), near, 0)[:, None], 0), np.inf)
    target = np.log2(np.maximum(some.sum(1), 2))
    lo, hi = np.full(len(far), 1e-12), np.full(len(far), 1e12)
    for _ in range(64):
        s = np.sqrt(lo * hi)
        low = np.exp(-far / s[:, None]).sum(1) < target
        lo, hi = np.where(low, s, lo), np.where(low, hi, s)
    return np.exp(-far / hi[:, None])


def _weighed(neighbors: DataFrame) -> DataFrame:
    """(src, dst, w) of (src, dst, rank, distance); a node's neighbours are few."""
    rows = neighbors.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "distance"))).alias("n"))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sizes = frame["d"].map(len).to_numpy()
                d = np.full((len(frame), sizes.max()), np.inf)
                on = np.arange(sizes.max()) < sizes[:, None]
                d[on] = np.concatenate(frame["d"].to_list())
                yield pd.DataFrame({"src": np.repeat(frame["src"].to_numpy(), sizes), "dst": np.concatenate(frame["dst"].to_list()), "w": memberships(d)[on]})

    return rows.select("src", F.col("n.dst").alias("dst"), F.col("n.distance").alias("d")).mapInPandas(weigh, "src long, dst long, w double")


def fuzzy(neighbors: DataFrame) -> DataFrame:
    """(i, j, w), each edge from both ends: the fuzzy union a + b - ab of the two memberships."""
    a, b = (F.coalesce(F.sum(F.when(F.col("src") < F.col("dst") if up else F.col("src") > F.col("dst"), F.col("w"))), F.lit(0.0)) for up in (True, False))
    pairs = _weighed(neighbors).groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg((a + b - a * b).alias("w"))
    ends = F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j")), F.struct(F.col("y").alias("i"), F.col("x").alias("j")))
    return pairs.where("w > 0").select(F.explode(ends).alias("e"), "w").select("e.i", "e.j", "w")


def curve(min_dist: float) -> tuple[float, float]:
    """a, b of the curve 1 / (1 + a d^2b) closest to a plateau of min_dist and exponential decay."""
    x = np.linspace(0, 3, 300)[1:]
    goal = np.where(x < min_dist, 1, np.exp(-(x - min_dist)))
    return min(((a, b) for a in np.linspace(0.2, 3, 57) for b in np.linspace(0.4, 1.6, 49)), key=lambda p: ((1 / (1 + p[0] * x ** (2 * p[1])) - goal) ** 2).sum())


def _coin(*keys: Column | int) -> Column:
    """A number from 0 to 1, the same for the same keys."""
    return F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)) / F.lit(2.0**64) + F.lit(0.5)


def _numbers(x: np.ndarray) -> np.ndarray:
    """Hashed 64-bit numbers (splitmix)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pushes(v: np.ndarray, y: np.ndarray, times: np.ndarray, ids: np.ndarray, at: np.ndarray, a: float, b: float, seed: int) -> np.ndarray:
    """The sum of each node's pushes, ``times`` of them, from nodes drawn out of a pool by hash."""
    step, ends = np.zeros(y.shape), np.cumsum(times)
    for first in range(0, int(ends[-1]) if len(ends) else 0, SLAB):
        place = np.arange(first, min(first + SLAB, int(ends[-1])))
        own = np.searchsorted(ends, place, "right")
        turn = (place - (ends - times)[own]).astype(np.uint64)
        r = (_numbers(_numbers(v[own].astype(np.uint64) + np.uint64(seed)) + turn) % np.uint64(len(ids))).astype(np.int64)
        d = y[own] - at[r]
        q = (d * d).sum(1)
        move = np.clip((2 * b / ((0.001 + q) * (1 + a * q**b)) * (ids[r] != v[own]))[:, None] * d, -4, 4)
        step += np.stack([np.bincount(own, move[:, c], len(v)) for c in range(y.shape[1])], 1)
    return step


def _pushed(rows: DataFrame, ids: np.ndarray, at: np.ndarray, rate: float, a: float, b: float, seed: int) -> DataFrame:
    """(v, y) of (v, y, pull, drawn): places moved by pulls and by pushes from a pool of places."""

    def push(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v, y, pull = frame["v"].to_numpy(np.int64), np.stack(frame["y"].to_list()), np.stack(frame["pull"].to_list())
                step = pull + pushes(v, y, frame["drawn"].to_numpy(np.int64) * PUSHES, ids, at, a, b, seed)
                yield pd.DataFrame({"v": v, "y": list(y + rate * np.clip(step, -4, 4))})

    return rows.mapInPandas(push, "v long, y array<double>")


def _pool(state: DataFrame, n: int, seed: int, epoch: int) -> list[Row]:
    """The ``POOL`` of n nodes (v, y) of the least hashes.  Each task would send so many, so those are asked
    first whose hashes are below a bound that somewhat more nodes are expected to meet."""
    code = F.xxhash64("v", F.lit(seed), F.lit(epoch))
    least = lambda rows: rows.orderBy(code, "v").limit(POOL).collect()
    share = (POOL + 6 * POOL**0.5) / max(n, 1)
    found = least(state.where(code < F.lit(int(share * 2**64) - 2**63))) if share < 1 else []
    return found if len(found) == POOL else least(state)


def spread(graph: DataFrame, n_components: int = 2, min_dist: float = 0.0, epochs: int = 200, seed: int = 0, few: int = 200_000) -> DataFrame:
    """(node_id, embedding) of a graph (i, j, w), laid out on the cluster from its eigenvectors; those
    of at most ``few`` edges are found on the driver."""
    graph = written(graph, "fuzzy")
    start, _ = spectrum.leading(graph, n_components + 1, seed, few)
    start = start.table(graph.sparkSession)
    top = start.agg(F.max(F.array_max(F.transform(F.slice("x", 2, n_components), F.abs)))).first()[0]
    noise = lambda c: (_coin(F.col("v"), seed, c) - 0.5) * 1e-3
    places = F.array(*(F.coalesce(F.get("x", F.lit(c + 1)), F.lit(0.0)) / F.lit((top or 1) / 10) + noise(c) for c in range(n_components)))
    state = written(start.select("v", places.alias("y")), "places")
    a, b = curve(min_dist)
    most = graph.agg(F.max("w")).first()[0]
    n = state.count()
    # Places are shuffled: small enough for a broadcast, they would pass the driver three times an epoch.
    at = lambda end: state.select(F.col("v").alias(end), F.col("y").alias(f"y{end}")).hint("merge")
    for epoch in range(epochs):
        # Both rows of an edge share a coin, so each end adds what the edge pulls it from either row.
        drawn = graph.where(_coin(seed, epoch, F.least("i", "j"), F.greatest("i", "j")) < F.col("w") / F.lit(most)).select("i", "j")
        d = [F.get("yi", F.lit(c)) - F.get("yj", F.lit(c)) for c in range(n_components)]
        met = drawn.join(at("j"), "j").join(at("i"), "i").select("i", *(e.alias(f"d{c}") for c, e in enumerate(d)))
        met = met.withColumn("q", sum((F.col(f"d{c}") * F.col(f"d{c}") for c in range(n_components)), F.lit(0.0)))
        slope = F.when(F.col("q") > 0, F.greatest(F.lit(-2 * a * b) * F.pow(F.greatest("q", F.lit(1e-12)), F.lit(b - 1)) / (1 + F.lit(a) * F.pow("q", F.lit(b))), F.lit(-4.0))).otherwise(0.0)
        moves = [2 * F.sum(F.greatest(F.least(slope * F.col(f"d{c}"), F.lit(4.0)), F.lit(-4.0))) for c in range(n_components)]
        pulls = met.groupBy(F.col("i").alias("v")).agg(F.array(*moves).alias("pull"), F.count("*").alias("drawn"))
        still = F.array(*[F.lit(0.0)] * n_components)
        rows = state.join(pulls.hint("merge"), "v", "left").select("v", "y", F.coalesce("pull", still).alias("pull"), F.coalesce("drawn", F.lit(0)).alias("drawn"))
        pool = _pool(state, n, seed, epoch)
        ids, held = np.array([r["v"] for r in pool], np.int64), np.array([r["y"] for r in pool], float)
        state = written(_pushed(rows, ids, held, 1 - epoch / epochs, a, b, seed * 100_003 + epoch), "places")
    return state.select(F.col("v").alias("node_id"), F.col("y").alias("embedding"))


def placed(fitted: DataFrame, new: DataFrame, k: int = 15, metric: str = "manhattan") -> DataFrame:
    """(node_id, embedding) of new nodes (node_id, vector): the mean place of each one's ``k`` nearest
    nodes of a layout (node_id, vector, embedding), weighted as a layout's edges are.  A node whose
    vector is among them is drawn to its place; ids of the two tables may clash."""
    own, asked = (vectors(t, "vector", "node_id").withColumn("side", F.lit(side).cast("long")) for side, t in ((1, fitted), (0, new)))
    both = own.join(fitted.select(F.col("node_id").alias("id"), "embedding"), "id").unionByName(asked, allowMissingColumns=True)
    both = written(both.select("side", F.col("id").alias("node_id"), "v", "embedding", F.monotonically_increasing_id().alias("id")), "both")
    v = F.col("v")
    if metric == "cosine":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        v = F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-300)))
    points = both.select(F.lit(0).cast("long").alias("grp"), "side", (F.col("side") == 0).alias("ask"), "id", v.alias("v"), F.lit(None).cast("array<double>").alias("w"))
    found = across.nearest(across.packed(points), k, metric=metric)
    distance = F.sqrt("d") if metric == "euclidean" else F.col("d")
    near = _weighed(found.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst")).alias("rank"), distance.alias("distance")))
    dim = fitted.select(F.size("embedding")).first()
    met = near.join(both.select(F.col("id").alias("dst"), "embedding"), "dst")
    means = met.groupBy(F.col("src").alias("id")).agg(F.array(*(F.sum(F.col("w") * F.get("embedding", F.lit(c))) / F.sum("w") for c in range(dim[0] if dim else 0))).alias("embedding"))
    return means.join(both.where("side = 0").select("id", "node_id"), "id").select("node_id", "embedding")
