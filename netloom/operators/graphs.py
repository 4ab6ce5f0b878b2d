"""Networks from coordinates: Delaunay triangulation, links for isolated nodes, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.model import KEYS
from netloom.operators import across, blocked

#: Distinct vectors whose answers are sent to all tasks.
VECTORS = 10_000


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Positive where a, b, c turn left; the sign is exact."""
    value = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if abs(value) > 1e-12:
        return float(value)
    (ax, ay), (bx, by), (cx, cy) = ([Fraction(float(v)) for v in p] for p in (a, b, c))
    return float((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def delaunay(xy: np.ndarray) -> np.ndarray:
    """The edges (i < j) of the triangulation, by inserting points from left to right: the circles
    that hold a new point open a hole, which it closes together with the edges of the hull that it
    sees.  Points that repeat an earlier one have no edges, points on one line link up along it."""
    n = len(xy)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    pts = (xy - xy.mean(0)) / max(float(np.ptp(xy, 0).max()), 1e-300)
    order = np.lexsort((pts[:, 1], pts[:, 0]))
    new = np.r_[True, (pts[order[1:]] != pts[order[:-1]]).any(1)]
    order = order[new].tolist()
    # The first points may lie on one line; with the next one they make the first triangles.
    m = next((k for k in range(2, len(order)) if _turn(pts[order[0]], pts[order[1]], pts[order[k]])), len(order))
    line = list(zip(order[: m - 1], order[1:m], strict=True))
    if m == len(order):
        return np.array(sorted(tuple(sorted(e)) for e in line), np.int64).reshape(-1, 2)

    def circle(a: int, b: int, c: int) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = pts[a], pts[b] - pts[a], pts[c] - pts[a]
        d = 2 * (bx * cy - by * cx)
        if not d:
            return 0.0, 0.0, np.inf
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        x, y = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        return ax + x, ay + y, x * x + y * y

    live = {t: circle(*t) for t in (tuple(sorted((i, j, order[m]))) for i, j in line)}
    done: list[tuple[int, int, int]] = []
    # The hull, anticlockwise, as a point's successor.
    around = [*order[:m], order[m]] if _turn(pts[order[0]], pts[order[1]], pts[order[m]]) > 0 else [*reversed(order[:m]), order[m]]
    hull = dict(zip(around, [*around[1:], around[0]], strict=True))
    for p in order[m + 1 :]:
        x, y = pts[p]
        rim: dict[tuple[int, int], int] = {}
        for t in list(live):
            cx, cy, r = live[t]
            if x > cx and (x - cx) ** 2 > r * (1 + 1e-9):
                done.append(t)
                del live[t]
            elif (x - cx) ** 2 + (y - cy) ** 2 < r * (1 - 1e-12):
                del live[t]
                for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                    rim[e] = rim.get(e, 0) + 1
        seen = {i: j for i, j in hull.items() if _turn(pts[i], pts[j], pts[p]) < 0}
        for i, j in seen.items():
            e = (min(i, j), max(i, j))
            rim[e] = rim.get(e, 0) + 1
        first, last = next(i for i in seen if i not in set(seen.values())), next(j for j in seen.values() if j not in seen)
        for i in seen:
            del hull[i]
        hull[first], hull[p] = p, last
        for (i, j), times in rim.items():
            if times == 1:
                t = tuple(sorted((i, j, p)))
                live[t] = circle(*t)
    edges = {e for t in (*done, *live) for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))}
    return np.array(sorted(edges), np.int64).reshape(-1, 2)


def build_delaunay(nodes: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, source, target): a triangulation per network.  A network's coordinates meet in one
    task, as its triangulation does; nodes without finite coordinates are left out."""
    own = nodes.select(*keys, "node_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    schema = own.select(*keys, F.col("node_id").alias("source"), F.col("node_id").alias("target")).schema

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[np.isfinite(frame[["x", "y"]].to_numpy(float)).all(1)].sort_values("node_id")
        edges, ids = delaunay(frame[["x", "y"]].to_numpy(float)), frame["node_id"].to_numpy()
        out = pd.DataFrame({"source": ids[edges[:, 0]], "target": ids[edges[:, 1]]})
        for k in reversed(list(keys)):
            out.insert(0, k, frame[k].iloc[0] if len(frame) else None)
        return out

    return own.groupBy(*keys).applyInPandas(one, schema)


def knn(nodes: DataFrame, vector: str, k: int, metric: str = "euclidean", node_id: str = "node_id", digits: int | None = None) -> DataFrame:
    """(src, dst, rank, distance): the ``k`` nearest others of each node; equal distances go to the
    smaller id.  ``digits`` rounds distances before they are compared.  Nodes without a vector of finite
    components take no part; a zero vector is at a cosine distance of 1 from all.

    Blocks of nodes meet in pairs, and only where their boxes come near enough (``blocked``); a last
    ranking joins the pairs' answers.  Of more than k + 1 equal vectors only the k + 1 smallest ids can be
    answers, so only those are searched, and the others take the answers of the first.
    """
    own = blocked.vectors(nodes, vector, node_id)
    copies = own.groupBy(F.xxhash64("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if copies <= k + 1:
        return _answers(_nearest(own, k, metric, digits), metric)
    # The limit is applied within tasks first, so a vector's copies never meet in one.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = blocked.written(own.withColumn("place", place).where(F.col("place") <= k + 1), "kept")
    firsts = kept.where("place = 1").select(F.col("id").alias("rep"), "v")
    near = _nearest(kept.select("id", "v"), k, metric, digits)
    lists = near.join(firsts.select(F.col("rep").alias("src")), "src", "left_semi").groupBy("src").agg(F.collect_list(F.struct("d", "dst")).alias("near"))
    # The first copy is an answer of the others; a zero vector is at a cosine distance of 1 from them too.
    apart = F.when(~F.exists("v", lambda e: e != 0), 1.0).otherwise(0.0) if metric == "cosine" else F.lit(0.0)
    whole = F.array_sort(F.concat(F.array(F.struct(apart.alias("d"), F.col("rep").alias("dst"))), F.coalesce("near", F.array().cast("array<struct<d:double,dst:bigint>>"))))
    found = firsts.join(lists, F.col("rep") == F.col("src"), "left").select("v", whole.alias("near"))
    found = F.broadcast(found) if firsts.count() <= VECTORS else found.hint("merge")
    each = own.join(found, "v").select(F.col("id").alias("src"), F.slice(F.filter("near", lambda e: e["dst"] != F.col("id")), 1, k).alias("near"))
    return _answers(each.select("src", F.posexplode("near").alias("at", "e")).select("src", "e.dst", "e.d", (F.col("at") + 1).alias("rank")), metric)


def _nearest(own: DataFrame, k: int, metric: str, digits: int | None) -> DataFrame:
    found = blocked.neighbours(blocked.blocks(own, k, metric, digits), k, metric, digits)
    order = Window.partitionBy("src").orderBy("d", "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answers(found: DataFrame, metric: str) -> DataFrame:
    return found.select("src", "dst", "rank", (F.sqrt("d") if metric == "euclidean" else F.col("d")).alias("distance"))


def link_isolated(nodes: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", k: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """The edges, and for each node without any those to its ``k`` nearest nodes of its network; equal
    distances go to the smaller id.  Nodes without finite coordinates take no part.

    Blocks of isolated nodes meet the near blocks of their network's nodes (``across``).
    """
    edges = edges.select(*keys, "source", "target")
    at = nodes.select(*keys, "node_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    order = [*keys, "node_id"]
    # Numbers follow the ids within a network and are kept.
    own = blocked.written(at.where(finite[0] & finite[1]).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "numbered")
    ends = edges.select(*keys, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    alone = blocked.written(own.join(ends, order, "left_anti"), "alone")
    if alone.isEmpty():
        return edges
    # A network's number is that of its first isolated node.
    marked = alone.groupBy(*keys).agg(F.min("id").alias("grp"))
    vector = F.array("x", "y").alias("v")

    def side(rows: DataFrame, number: int) -> DataFrame:
        return rows.join(marked, [*keys]).select("grp", F.lit(number).cast("long").alias("side"), F.lit(number == 0).alias("ask"), "id", vector, F.lit(None).cast("array<double>").alias("w"))

    found = across.nearest(across.packed(side(alone, 0).unionByName(side(own, 1))), k, itself=True).select("src", "dst")
    first = own.select(*keys, F.col("id").alias("src"), F.col("node_id").alias("n"))
    second = own.select(F.col("id").alias("dst"), F.col("node_id").alias("m"))
    linked = found.join(first, "src").join(second, "dst").select(*keys, F.least("n", "m").alias("source"), F.greatest("n", "m").alias("target")).distinct()
    return edges.unionByName(linked)
