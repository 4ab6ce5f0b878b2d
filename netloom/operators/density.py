"""Density clusters from an exact hierarchy over all pairs of points.

The minimum spanning tree of mutual reachability lies within the trees of all blocks and those of the
links between each two blocks; squares of pairs of blocks find these in tasks of their own and keep what
no cycle of theirs rules out.  Pairs whose boxes are farther apart than any edge of one spanning tree are
left out.  Products choose the links between blocks, weights are sums of differences.  The trees' edges are then merged in ranges
of weights, at most about ``RANGE`` edges in a task: a range joins components, and a component is
only its size and the cluster that is growing in it, so ranges hand on a few numbers a component.
Clusters die where two of them meet; which of them are kept is known from below, and a kept cluster
above others replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import blocked
from netloom.operators.blocked import candidates, exact, table, written

#: Edges that a task merges, about.
RANGE = 500_000
EDGES = "a long, b long, w double"
#: Distances below so many times the room for a product's rounding are sums of differences.
CLOSE = 1e6
#: Sides of squares whose edges are thinned together.
SIDES = 8


def spanning(ids: np.ndarray, x: np.ndarray, core: np.ndarray, metric: str) -> pd.DataFrame:
    """The minimum spanning tree of mutual reachability, a point at a time."""
    n = len(ids)
    best, near, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    out, at = [], 0
    for _ in range(n - 1):
        left[at] = False
        d = np.maximum(np.maximum(exact(x, x[at], metric), core), core[at])
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        out.append((min(ids[at], ids[near[at]]), max(ids[at], ids[near[at]]), best[at]))
    return pd.DataFrame(out, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})


def crossing(a: np.ndarray, x: np.ndarray, c: np.ndarray, b: np.ndarray, y: np.ndarray, e: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) of a minimum spanning tree of the links from points a to points b, with cores c and e."""
    d, step = np.empty((len(x), len(y))), max(1, blocked.SLAB // max(1, len(y)))
    for i in range(0, len(x), step):
        near, room = table(x[i : i + step], y, metric)
        # Products round small distances away.
        r, q = np.divmod(np.flatnonzero(near <= CLOSE * room[:, None]), len(y))
        for j in range(0, len(r), 65536):
            near[r[j : j + 65536], q[j : j + 65536]] = exact(x[i + r[j : j + 65536]], y[q[j : j + 65536]], metric)
        d[i : i + step] = np.maximum(np.maximum(near, e), c[i : i + step, None])
    # For each side: the least weight of a point's links to the tree, -inf within it; the same for picking, inf within it.
    least, pick, near = ([np.full(len(p), v) for p in (x, y)] for v in (np.inf, np.inf, 0))
    ends, side, at = [], 0, 0
    least[0][0] = -np.inf
    for _ in range(len(x) + len(y) - 1):
        row, other = (d[at], 1) if side == 0 else (d[:, at], 0)
        closer = np.flatnonzero(row < least[other])
        least[other][closer] = pick[other][closer] = row[closer]
        near[other][closer] = at
        one, two = int(pick[0].argmin()), int(pick[1].argmin())
        side, at = (0, one) if pick[0][one] <= pick[1][two] else (1, two)
        ends.append((at, int(near[0][at])) if side == 0 else (int(near[1][at]), at))
        least[side][at], pick[side][at] = -np.inf, np.inf
    i, j = np.array(ends, np.int64).reshape(-1, 2).T
    return a[i], b[j], np.maximum(np.maximum(exact(x[i], y[j], metric), c[i]), e[j])


def thinned(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges make up a minimum spanning forest."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(w, kind="stable")
    up, kept = list(range(len(ids))), []
    for k, x, y in zip(order.tolist(), ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _edges(a: np.ndarray, b: np.ndarray, w: np.ndarray, **more) -> pd.DataFrame:
    keep = thinned(a, b, w)
    return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "w": w[keep], **more})


def _with(own: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Blocks (block, ids, ...) with the points' values (id, value), in the order of their ids."""

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, raw in zip(frame["block"], frame["ids"], strict=True):
                yield pd.DataFrame({"block": block, "id": np.frombuffer(raw, np.int64)})

    every = own.select("block", "ids").mapInPandas(ids, "block long, id long").join(values, "id")
    sides = every.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("v")).select("block", F.col("v.id").alias("_ids"), F.col("v.value").alias(name))
    return own.join(sides, "block")


def _values(row, name: str) -> np.ndarray:
    ids = np.frombuffer(row["ids"], np.int64)
    return np.asarray(row[name])[np.searchsorted(np.asarray(row["_ids"]), ids)]


def tree_edges(df: DataFrame, vector: str, min_samples: int, metric: str, node_id: str) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b, w), blocks), written: edges that hold a minimum spanning tree of mutual
    reachability; ``w`` is squared where the metric is Euclidean."""
    own = blocked.blocks(blocked.vectors(df, vector, node_id), min_samples, metric)
    near = blocked.neighbours(own, min_samples, metric)
    core = near.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("d")).alias("ds")).select("id", F.expr(f"ds[least(size(ds), {min_samples}) - 1]").alias("value"))
    # A lone point has no neighbour and no tree.
    own = written(_with(own.select("block", "ids", "x", "low", "high"), core, "core"), "cored")

    def inner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                ids = np.frombuffer(row["ids"], np.int64)
                x, c = np.frombuffer(row["x"]).reshape(len(ids), -1), _values(row, "core")
                tree = spanning(ids, x, c, metric)
                # Besides the tree, the two ends of the block: they link it with the blocks before and after.
                yield pd.DataFrame({
                    "block": [row["block"]], "edges": [tree.to_numpy(float)[:, 2].max(initial=0)], "a": [tree["a"].to_numpy(np.int64).tobytes()], "b": [tree["b"].to_numpy(np.int64).tobytes()],
                    "w": [tree["w"].to_numpy(float).tobytes()], "first": [x[0].tobytes()], "last": [x[-1].tobytes()], "c0": [c[0]], "c1": [c[-1]],
                })

    # A scan of few files would be a few tasks.
    dealt = own.repartition(max(1, min(own.count(), 1000)), "block")
    trees = written(dealt.mapInPandas(inner, "block long, edges double, a binary, b binary, w binary, first binary, last binary, c0 double, c1 double"), "trees")

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"a": np.frombuffer(row.a, np.int64), "b": np.frombuffer(row.b, np.int64), "w": np.frombuffer(row.w)})

    edges = trees.select("a", "b", "w").mapInPandas(opened, EDGES)
    if trees.count() > 1:
        # Blocks in order, two rows a block's worth of numbers each: the largest edge of a spanning tree.
        after = Window.orderBy("block")
        links = trees.select("edges", "last", "c1", F.lead("first").over(after).alias("first"), F.lead("c0").over(after).alias("c0"))

        def largest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                link = [0.0 if r.first is None else max(float(exact(np.frombuffer(r.last)[None], np.frombuffer(r.first), metric)[0]), r.c1, r.c0) for r in frame.itertuples()]
                yield pd.DataFrame({"reach": [max(frame["edges"].max(), *link)] if len(frame) else []})

        reach = links.mapInPandas(largest, "reach double").agg(F.max("reach")).first()[0]
        met = blocked.pairs(own.select("block", "low", "high", F.lit(float(reach) * (1 + 1e-9)).alias("reach")), metric)

        def search(key: tuple, rows: dict, met: list[tuple[int, int]]) -> pd.DataFrame:
            held = {k: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"]).reshape(len(r["ids"]) // 8, -1), _values(r, "core")) for k, r in rows.items()}
            found = [crossing(*held[one], *held[two], metric) for one, two in met]
            return _edges(*(np.concatenate(v) for v in zip(*found, strict=True)), g=key[0], h=key[1])

        links = written(blocked.squares(own.select("block", "ids", "x", "_ids", "core"), met, search, f"{EDGES}, g int, h int"), "links")
        n = own.agg(F.sum(F.length("ids"))).first()[0] // 8
        # Squares that share points rule out more of each other's edges, never all in one task.
        while links.count() > 4 * n and (links.agg(F.max("h")).first()[0] or 0) >= 2 * SIDES:
            wider = links.select("a", "b", "w", *(F.floor(F.col(c) / F.lit(SIDES)).cast("int").alias(c) for c in ("g", "h")))
            links = written(wider.groupBy("g", "h").applyInPandas(lambda key, r: _edges(*(r[c].to_numpy() for c in "abw"), g=key[0], h=key[1]), f"{EDGES}, g int, h int"), "links")
        edges = edges.unionByName(links.select("a", "b", "w"))
    return written(edges, "tree-edges"), own


def _ranges(edges: DataFrame) -> list[DataFrame]:
    """The edges in ranges of rising weight, about RANGE edges each.  Equal weights stay together
    unless they alone are more, then they meet one part after the other."""
    n = edges.count()
    if n <= RANGE:
        return [edges]
    parts = -(-n // RANGE)
    cuts = sorted(set(edges.agg(F.percentile_approx("w", F.array(*(F.lit(i / parts) for i in range(1, parts))), 100_000)).first()[0]))
    out, below = [], F.lit(True)
    for cut in [*cuts, None]:
        out.append(edges.where(below if cut is None else below & (F.col("w") < cut)))
        if cut is not None:
            same = edges.where(F.col("w") == cut)
            times = max(1, -(-same.count() // RANGE))
            out += [same.where(F.pmod(F.xxhash64("a", "b"), F.lit(times)) == i) for i in range(times)]
            below = F.col("w") > cut
    return out


STATE = ("size", "cluster", "total", "inner", "kids")
OUT = "kind string, a long, b long, size long, cluster long, total double, inner double, kids boolean, keep boolean"


def merged(rows: pd.DataFrame, least: int, first: int, root: bool) -> pd.DataFrame:
    """Merge components along edges (a, b, w), equal weights at once: rows tell what became of components ('comp'), which
    clusters their points joined ('join') and which clusters ended ('end').  ``total`` sums the
    densities at which a cluster's points leave it, ``inner`` what the best clusters below it are worth."""
    ids = np.unique(rows[["a", "b"]].to_numpy(np.int64))
    size, cluster, total, inner, kids = [1] * len(ids), [-1] * len(ids), [0.0] * len(ids), [0.0] * len(ids), [False] * len(ids)
    at_a, at_b = np.searchsorted(ids, rows["a"]).tolist(), np.searchsorted(ids, rows["b"]).tolist()
    for end, at in (("a", at_a), ("b", at_b)):
        for i, *own in zip(at, *(rows[f"{c}_{end}"].tolist() for c in STATE), strict=True):
            size[i], cluster[i], total[i], inner[i], kids[i] = own
    up, members = list(range(len(ids))), [[i] for i in range(len(ids))]
    joins, ends, next_ = [], [], first

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def end(x: int, level: float, parent: int | None) -> float:
        worth = total[x] - size[x] * level
        # The whole is only a cluster where nothing in it is one.
        keep = not kids[x] or (parent is not None and worth >= inner[x])
        ends.append((cluster[x], parent, keep))
        return worth if keep else inner[x]

    def join(x: int, to: int) -> None:
        joins.extend((i, to) for i in members[x])
        members[x] = []

    def meet(roots: list[int], level: float) -> None:
        """Components that one height brings together, all at once."""
        nonlocal next_
        large, all_ = [r for r in roots if cluster[r] >= 0], sum(size[r] for r in roots)
        small = [r for r in roots if cluster[r] < 0]
        to = large[0] if large else max(small, key=lambda r: len(members[r]))
        if len(large) == 1:
            total[to] += (all_ - size[to]) * level
        elif large or all_ >= least:
            worth = sum(end(r, level, next_) for r in large)
            cluster[to], total[to], inner[to], kids[to] = next_, all_ * level, worth, bool(large)
            next_ += 1
        for r in small:
            if cluster[to] >= 0:
                join(r, cluster[to])
            elif r != to:
                members[to] += members[r]
                members[r] = []
        for r in roots:
            up[r] = to
        size[to] = all_

    d = rows["w"].to_numpy(float)
    order = np.argsort(d, kind="stable")
    starts = np.flatnonzero(np.r_[True, d[order][1:] != d[order][:-1]]) if len(d) else []
    for start, stop in zip(starts, [*starts[1:], len(d)], strict=True):
        links = [(find(at_a[e]), find(at_b[e])) for e in order[start:stop].tolist()]
        links, level = [(x, y) for x, y in links if x != y], 1 / max(d[order[start]], 1e-12)
        if len(links) == 1:
            meet(list(links[0]), level)
        elif links:
            near: dict[int, list[int]] = {}
            for x, y in links:
                near.setdefault(x, []).append(y)
                near.setdefault(y, []).append(x)
            seen: set[int] = set()
            for x in sorted(near):
                if x not in seen:
                    seen.add(x)
                    group = [x]
                    for r in group:
                        new = [y for y in near[r] if y not in seen]
                        new = list(dict.fromkeys(new))
                        seen.update(new)
                        group += new
                    meet(group, level)
    tops = [find(i) for i in range(len(ids))]
    if root:
        for t in sorted(set(tops)):
            if cluster[t] >= 0:
                end(t, 0.0, None)
    names = [c.split()[0] for c in OUT.split(", ")]
    out = [("comp", ids[i], ids[t], size[t], cluster[t], total[t], inner[t], kids[t], None) for i, t in enumerate(tops)]
    out += [("join", ids[i], c, None, None, None, None, None, None) for i, c in joins] + [("end", c, p, None, None, None, None, None, k) for c, p, k in ends]
    return pd.DataFrame(out, columns=names).astype({"a": "Int64", "b": "Int64", "size": "Int64", "cluster": "Int64", "total": float, "inner": float, "kids": "boolean", "keep": "boolean"})


def _run(least: int, first: int, root: bool):
    return lambda frame: merged(frame, least, first, root)


def clusters(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((id, cluster) of points that are in one, (cluster, parent, keep)) of tree edges (a, b, w)."""
    place, state, joined, ended = None, None, [], []
    parts = _ranges(edges)
    for number, part in enumerate(parts):
        root = number == len(parts) - 1
        rows = part
        for end in ("a", "b"):
            if place is None:
                rows = rows.withColumns({f"size_{end}": F.lit(1), f"cluster_{end}": F.lit(-1), f"total_{end}": F.lit(0.0), f"inner_{end}": F.lit(0.0), f"kids_{end}": F.lit(False)})
            else:
                own = place.join(state, "comp").select(F.col("id").alias(end), F.col("comp").alias(f"comp_{end}"), *(F.col(c).alias(f"{c}_{end}") for c in STATE))
                fresh = {"comp": F.col(end), "size": F.lit(1), "cluster": F.lit(-1), "total": F.lit(0.0), "inner": F.lit(0.0), "kids": F.lit(False)}
                rows = rows.join(own, end, "left").withColumns({f"{c}_{end}": F.coalesce(f"{c}_{end}", v) for c, v in fresh.items()}).drop(end).withColumnRenamed(f"comp_{end}", end)
        run = _run(least, (number + 1) << 40, root)
        # The last range runs even where it is empty of edges between components: it ends what is left.
        out = written(rows.where(F.lit(root) | (F.col("a") != F.col("b"))).withColumn("range", F.lit(number)).groupBy("range").applyInPandas(run, OUT), "merged")
        comps = out.where("kind = 'comp'")
        to = comps.select(F.col("a").alias("comp"), F.col("b").alias("to"))
        joins = out.where("kind = 'join'").select(F.col("a").alias("comp"), F.col("b").alias("cluster"))
        ended.append(out.where("kind = 'end'").select(F.col("a").alias("cluster"), F.col("b").alias("parent"), "keep"))
        if place is None:
            joined.append(joins.withColumnRenamed("comp", "id"))
            place = to.select(F.col("comp").alias("id"), F.col("to").alias("comp"))
        else:
            # Points that this range is the first to touch are components of their own.
            known = place.unionByName(to.join(place, "comp", "left_anti").join(place.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("id"), "comp"))
            joined.append(written(known.join(joins, "comp").select("id", "cluster"), "joined"))
            place = written(known.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "place")
        now = comps.groupBy(F.col("b").alias("comp")).agg(*(F.first(c).alias(c) for c in STATE))
        state = written(now if state is None else state.join(to, "comp", "left_anti").unionByName(now), "state")
    every = lambda tables: tables[0] if len(tables) == 1 else every(tables[:-1]).unionByName(tables[-1])
    return every(joined), every(ended)


def kept(ended: DataFrame) -> DataFrame:
    """(cluster, top): the topmost kept cluster at or above each, by jumping to parents' parents."""
    jumps = written(ended.select("cluster", F.when(F.col("keep"), F.col("cluster")).alias("top"), F.col("parent").alias("up")), "jumps")
    while not jumps.where("up is not null").isEmpty():
        above = jumps.select(F.col("cluster").alias("up"), F.col("top").alias("top2"), F.col("up").alias("up2"))
        jumps = written(jumps.join(above, "up", "left").select("cluster", F.coalesce("top2", "top").alias("top"), F.col("up2").alias("up")), "jumps")
    return jumps.where("top is not null").select("cluster", "top")


def _adopted(own: DataFrame, labels: DataFrame, metric: str) -> DataFrame:
    """(node_id, label): noise takes the label of its nearest point that has one; equal distances go to
    the smaller id."""
    own = written(_with(own.select("block", "ids", "x", "low", "high"), labels.select(F.col("node_id").alias("id"), F.col("label").alias("value")), "label"), "labelled")

    def sides(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, np.frombuffer(row["x"]).reshape(len(ids), -1), _values(row, "label")

    def nearest(one, two, bound: np.ndarray) -> pd.DataFrame:
        (a, x, la), (b, y, lb) = one, two
        lost, found = la < 0, lb >= 0
        at, near, d = candidates(x[lost], a[lost], y[found], b[found], bound, 1, metric)
        order = np.argsort(b)
        label = lb[order][np.searchsorted(b[order], near.astype(np.int64))] if len(near) else []
        return pd.DataFrame({"id": a[lost][at.astype(np.int64)], "near": near.astype(np.int64), "d": d.astype(float), "label": np.asarray(label, np.int64)})

    def inner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                one = sides(row)
                lost = one[0][one[2] < 0]
                found = nearest(one, one, np.full(len(lost), np.inf))
                bound = np.full(len(lost), np.inf)
                order = np.argsort(lost)
                if len(found):
                    bound[order[np.searchsorted(lost[order], found["id"])]] = found["d"]
                yield pd.DataFrame({"block": [row["block"]], "bound": [bound.tobytes()], "reach": [float(bound.max(initial=-1.0))], "found": [found.to_numpy(float).tobytes()]})

    first = own.join(own.select("block", "ids", "x", "_ids", "label").mapInPandas(inner, "block long, bound binary, reach double, found binary"), "block")
    first = written(first, "adopting")

    def search(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        p, q = sides(one), sides(two)
        return pd.concat([nearest(p, q, np.frombuffer(one["bound"])), nearest(q, p, np.frombuffer(two["bound"]))])

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["found"]:
                yield pd.DataFrame(np.frombuffer(raw).reshape(-1, 4), columns=["id", "near", "d", "label"]).astype({"id": "int64", "near": "int64", "label": "int64"})

    schema = "id long, near long, d double, label long"
    found = first.select("found").mapInPandas(opened, schema).unionByName(blocked.meet(first.drop("found", "low", "high", "reach"), blocked.pairs(first, metric), search, schema))
    best = found.groupBy(F.col("id").alias("node_id")).agg(F.min_by("label", F.struct("d", "near")).alias("own"))
    return labels.join(best, "node_id", "left").select("node_id", F.coalesce("own", "label").cast("int").alias("label"))


def hdbscan(df: DataFrame, vector: str, min_cluster_size: float, min_samples: int, noise_to_cluster: bool, metric: str, node_id: str) -> DataFrame:
    """(node_id, label), -1 for noise."""
    edges, own = tree_edges(df, vector, min_samples, metric, node_id)
    height = edges.select("a", "b", (F.sqrt("w") if metric == "euclidean" else F.col("w")).alias("w"))
    points = blocked.vectors(df, vector, node_id).select(F.col("id").alias("node_id"))
    n = points.count()
    least = max(2, int(round(min_cluster_size * n)) if min_cluster_size < 1 else int(min_cluster_size))
    joined, ended = clusters(height, least)
    tops = joined.join(kept(ended), "cluster").select(F.col("id").alias("node_id"), "top")
    # Clusters are numbered by their smallest point.
    order = tops.groupBy("top").agg(F.min("node_id").alias("first"))
    order = order.select("top", (F.row_number().over(Window.orderBy("first")) - 1).alias("label"))
    labels = written(points.join(tops.join(order, "top"), "node_id", "left").select("node_id", F.coalesce("label", F.lit(-1)).alias("label")), "density")
    return _adopted(own, labels, metric) if noise_to_cluster else labels
