"""Communities of graphs of any size: local moving, refinement and contraction over edge tables.

A graph is a table (i, j, w) with each edge from both ends; loops stand once and weigh what their
inner edges weigh from both ends.  In a round of moving, each node joins the neighbouring community
of the largest gain, from sums of its links by community and of communities' volumes; only half of
the nodes may move in a round, so neighbours don't swap for ever.  Refinement starts from single
nodes within each community, in tasks of many communities each; connected parts are kept.  In a
community too large for that, single nodes join neighbours that stay, so what comes together is
connected.  Refined communities are the nodes of the next, smaller graph.

Tables of nodes and edges meet by merges on both sides' keys: broadcasts of them would go through
the driver in every round.  Runs over one graph move together: a node is one row with its communities
of all runs, and a block of nodes gets the rows of its neighbours once a round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.blocked import written

#: Rounds of moving and of refinement at each level.
MOVES, MERGES = 12, 4
#: Inner edges, from both ends, that a task refines at a time; larger communities are refined in rounds.
GROUP = 1_000_000
#: Edges, from both ends, of a block of nodes: at least so many, where there are blocks for all tasks, and at most.
LOW, HIGH = 1 << 16, 1 << 20
#: Rounds of moving end once at most one in so many nodes moved.
STILL = 1000
#: A gain below this is none: sums depend on their order.
LEAST = 1e-9


def both_ends(edges: DataFrame) -> DataFrame:
    """(i, j, w), written, of edges (src, dst, weight) that may be repeated: the largest weight counts."""
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("w"))
    once = pair.groupBy("a", "b").agg(F.max("w").alias("w"))
    ends = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")))).otherwise(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))))
    return written(once.select(ends.alias("e"), "w").select("e.i", "e.j", "w"), "graph")


def degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy(F.col("i").alias("v")).agg(F.sum("w").alias("k"))


def _turn() -> Column:
    """Whether a node may move in this round; it differs by run, node and round."""
    return F.pmod(F.xxhash64("r", "v", "turn"), F.lit(2)) == 0


def _gains(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(r, v, k, c, scale, turn, alone, stay, to, gain): what each node gains in its community and in the best
    other one, null where it has no links to others.  ``nodes`` are (r, v, k, c, scale, turn) for runs r over
    the same graph: the resolution over all volume, and the number of the round.  Both are columns, so that
    Spark compiles a round's code once and not for each round."""
    volumes = nodes.groupBy("r", "c").agg(F.sum("k").alias("volume"), F.count("*").alias("members"))
    known = nodes.join(volumes.hint("merge"), ["r", "c"])
    there = known.select("r", F.col("v").alias("j"), F.col("c").alias("to"), F.col("volume").alias("there"))
    # Edges are dealt once, by (r, v), for all that follows.
    met = graph.where("i <> j").join(there.hint("merge"), "j").select("r", F.col("i").alias("v"), "to", "w", "there").repartition("r", "v")
    links = met.groupBy("r", "v", "to").agg(F.sum("w").alias("w"), F.first("there").alias("there"))
    own = F.col("to") == F.col("c")
    gain = F.col("w") - F.col("scale") * F.col("k") * F.when(own, F.col("volume") - F.col("k")).otherwise(F.col("there"))
    best = known.join(links.hint("merge"), ["r", "v"], "left").withColumn("gain", gain).groupBy("r", "v").agg(
        F.max(F.when(own, F.col("gain"))).alias("stay"), F.max(F.when(~own, F.struct("gain", (-F.col("to")).alias("to")))).alias("best"),
        *(F.first(n).alias(n) for n in ("k", "c", "scale", "turn", "volume", "members")),
    )
    stay = F.coalesce("stay", -F.col("scale") * F.col("k") * (F.col("volume") - F.col("k")))
    return best.select("r", "v", "k", "c", "scale", "turn", (F.col("members") == 1).alias("alone"), stay.alias("stay"), (-F.col("best.to")).alias("to"), F.col("best.gain").alias("gain"))


def _started(nodes: DataFrame, total: float, gamma: float, seed: int) -> DataFrame:
    """Nodes (r, v, k, c, scale, turn) before the first round."""
    return nodes.select("r", "v", "k", "c", F.lit(float(gamma / total)).alias("scale"), F.lit(1000 * seed).cast("long").alias("turn"))


def blocks(graph: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(near, needed, edges), written: (block, v, near), the neighbours [(j, w)] of each node that has any,
    and (block, v, own), the nodes of each block and their neighbours."""
    edges, spread = graph.count(), int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-edges // HIGH), min(2 * spread, edges // LOW), min(spread, edges // 2000))
    block = lambda v: F.pmod(F.xxhash64(v), F.lit(n)).cast("int").alias("block")
    links = graph.where("i <> j")
    near = links.groupBy(block("i"), F.col("i").alias("v")).agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("near"))
    ends = links.select(block("i"), F.col("j").alias("v"), F.lit(False).alias("own")).unionByName(graph.select(block("i"), F.col("i").alias("v"), F.lit(True).alias("own")))
    return written(near, "near"), written(ends.groupBy("block", "v").agg(F.max("own").alias("own")), "needed"), edges


def met(near: DataFrame, needed: DataFrame, known: DataFrame, f: Callable, schema: str) -> DataFrame:
    """What ``f`` makes of each block's neighbours and the rows ``known`` (v, ..) of its nodes and theirs."""
    rows = needed.join(known.hint("merge"), "v")
    return near.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(f, schema)


def _column(table: pa.Table, name: str, runs: int | None = None) -> np.ndarray:
    """A column without nulls; with ``runs``, one of arrays of so many values."""
    values = table[name].combine_chunks()
    return values.to_numpy(zero_copy_only=False) if runs is None else values.flatten().to_numpy().reshape(-1, runs)


def edges_of(near: pa.Table, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, w) of a block's edges; i and j are places in the sorted ids ``v``."""
    lists = near["near"].combine_chunks()
    j, w = (lists.flatten().field(n).to_numpy() for n in ("j", "w"))
    i = np.repeat(np.searchsorted(v, _column(near, "v")), lists.value_lengths().to_numpy())
    return i, np.searchsorted(v, j), w


def _turns(v: np.ndarray, r: int, turn: int) -> np.ndarray:
    """Whether nodes may move in this round; it differs by run, node and round."""
    x = v.astype(np.uint64) ^ np.uint64((r * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(63)) == 0


def _best(i: np.ndarray, j: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, volume: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, communities): the nodes that gain by moving, and where they gain most; of equal gains
    the smaller community's counts."""
    names, code = np.unique(c, return_inverse=True)
    there = np.zeros(len(names))
    there[code] = volume
    key = i * len(names) + code[j]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    at, to = np.divmod(key[first], len(names))
    own = to == code[at]
    gain = np.add.reduceat(w[order], first) - scale * k[at] * (there[to] - np.where(own, k[at], 0.0))
    stay = -scale * k * (there[code] - k)
    stay[at[own]] = gain[own]
    at, to, gain = at[~own], to[~own], gain[~own]
    if not len(at):
        return at, names[to]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    most = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.r_[first, len(at)]))
    hit = np.flatnonzero(gain == most)
    hit = hit[np.unique(at[hit], return_index=True)[1]]
    hit = hit[gain[hit] > stay[at[hit]] + LEAST]
    return at[hit], names[to[hit]]


def moved_together(near: DataFrame, needed: DataFrame, edges: int, nodes: DataFrame, gamma: float, seed: int, rounds: int = MOVES) -> DataFrame:
    """The nodes (v, k, c), written, after rounds of moving, or once hardly any node moves.  ``c`` has the
    community of each run.  A graph of at most HIGH ``edges`` goes through all rounds of a run in one task."""
    seen = nodes.agg(F.sum("k").alias("total"), F.count("*").alias("n"), F.max(F.size("c")).alias("runs")).first()
    total, n, runs = seen["total"] or 0, seen["n"], seen["runs"]
    if total <= 0 or not runs:
        return nodes

    def alone(key: tuple, near: pa.Table, known: pa.Table) -> pa.Table:
        known, r = known.sort_by("v"), key[0].as_py()
        v, k, c = (_column(known, name) for name in ("v", "k", "c"))
        c = c.copy()
        for number in range(rounds if near.num_rows else 0):
            i, j, w = edges_of(near, v) if not number else (i, j, w)
            code = np.unique(c, return_inverse=True)[1]
            at, to = _best(i, j, w, k, c, np.bincount(code, k)[code], gamma / total)
            go = _turns(v[at], r, 1000 * seed + number)
            c[at[go]] = to[go]
            if number % 2 and go.sum() <= n // STILL // runs:
                break
        return pa.table({"r": np.full(len(v), r, np.int32), "v": v, "k": k, "c": c})

    if edges <= HIGH:
        each = nodes.select("v", "k", F.posexplode("c").alias("r", "c")).groupBy("r")
        apart = near.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("r"), "v", "near").groupBy("r")
        found = apart.cogroup(each).applyInArrow(alone, "r int, v long, k double, c long").groupBy("v")
        packed = found.agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("r", "c"))).alias("of"))
        return written(packed.select("v", "k", F.col("of.c").alias("c")), "moved")

    def step(turn: int) -> Callable:
        def move(near: pa.Table, known: pa.Table) -> pa.Table:
            known = known.sort_by("v")
            v, k, own = (_column(known, name) for name in ("v", "k", "own"))
            c, volume = _column(known, "c", runs), _column(known, "volume", runs)
            after, went = c.copy(), np.zeros(len(v), np.int32)
            if near.num_rows:
                i, j, w = edges_of(near, v)
                for r in range(runs):
                    at, to = _best(i, j, w, k, c[:, r], volume[:, r], gamma / total)
                    go = _turns(v[at], r, turn)
                    after[at[go], r] = to[go]
                    went[at[go]] += 1
            after = pa.ListArray.from_arrays(np.arange(0, own.sum() * runs + 1, runs, dtype=np.int32), after[own].ravel())
            return pa.table({"v": v[own], "k": k[own], "c": after, "went": went[own]})

        return move

    for number in range(rounds):
        each = nodes.select("v", "k", F.posexplode("c").alias("r", "c"))
        volumes = each.groupBy("r", "c").agg(F.sum("k").alias("volume"))
        known = each.join(volumes.hint("merge"), ["r", "c"]).groupBy("v").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("r", "c", "volume"))).alias("of"))
        known = known.select("v", "k", F.col("of.c").alias("c"), F.col("of.volume").alias("volume"))
        nodes = written(met(near, needed, known, step(1000 * seed + number), "v long, k double, c array<long>, went int"), "moved")
        if number % 2 and nodes.agg(F.sum("went")).first()[0] <= n // STILL:
            break
    return nodes.select("v", "k", "c")


def moved(graph: DataFrame, nodes: DataFrame, gamma: float, seed: int, rounds: int = MOVES) -> DataFrame:
    """The nodes (r, v, k, c), written, of one run after rounds of moving (``moved_together``)."""
    out = moved_together(*blocks(graph), nodes.select("v", "k", F.array("c").alias("c")), gamma, seed, rounds)
    return out.select(F.lit(0).alias("r"), "v", "k", F.get("c", F.lit(0)).alias("c"))


def settled(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, gamma: float, rng: np.random.Generator, label: np.ndarray, fixed: np.ndarray | None = None, degree: np.ndarray | None = None, total: float | None = None) -> np.ndarray:
    """Local moving: nodes join the neighbouring community of the largest gain, until none moves.
    With ``fixed``, nodes only join communities within the same fixed one.  ``degree`` and ``total``
    are given where these are not all edges."""
    order = np.argsort(i, kind="stable")
    i, j, w = i[order], j[order], w[order]
    start = np.searchsorted(i, np.arange(n + 1))
    degree = np.bincount(i, w, n) if degree is None else degree
    total, label = max(degree.sum() if total is None else total, 1e-300), label.copy()
    volume = np.bincount(label, degree, n)
    queue, waiting = list(rng.permutation(n)), np.ones(n, bool)
    while queue:
        later = []
        for v in queue:
            waiting[v] = False
            to, own = j[start[v] : start[v + 1]], w[start[v] : start[v + 1]]
            some = to != v
            if fixed is not None:
                some &= fixed[to] == fixed[v]
            to, own = to[some], own[some]
            if not len(to):
                continue
            volume[label[v]] -= degree[v]
            found, at = np.unique(np.r_[label[v], label[to]], return_inverse=True)
            gain = np.bincount(at[1:], own, len(found)) - gamma * degree[v] * volume[found] / total
            stay = gain[at[0]]
            best = found[gain.argmax()] if gain.max() > stay + 1e-12 else label[v]
            volume[best] += degree[v]
            if best != label[v]:
                label[v] = best
                for u in to[label[to] != best]:
                    if not waiting[u]:
                        waiting[u] = True
                        later.append(u)
        queue = later
    return label


def connected(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels, with each community's connected pieces told apart: that never lowers modularity."""
    piece, inner = np.arange(len(label)), label[i] == label[j]
    a, b = i[inner], j[inner]
    while True:
        least = piece.copy()
        np.minimum.at(least, a, piece[b])
        least = least[least]
        if (least == piece).all():
            return np.unique(piece, return_inverse=True)[1]
        piece = least


def _merged(inner: DataFrame, parts: DataFrame, total: float, gamma: float, seed: int, rounds: int) -> DataFrame:
    """The parts (r, v, k, c), written, after rounds in which single nodes join others along ``inner`` edges."""
    parts = _started(parts, total, gamma, seed)
    for _ in range(rounds):
        gains = _gains(inner, parts).where((F.col("gain") > F.col("stay") + LEAST) & F.col("alone"))
        # Single nodes move in their turn.  What they join is a part that stays: one of several
        # nodes, or a single one whose turn it isn't.
        size = parts.groupBy("r", F.col("c").alias("to")).agg(F.count("*").alias("size"))
        head = F.pmod(F.xxhash64("r", "to", "turn"), F.lit(2)) != 0
        go = gains.where(_turn()).join(size.hint("merge"), ["r", "to"]).where((F.col("size") > 1) | head).select("r", "v", "to")
        parts = written(parts.join(go.hint("merge"), ["r", "v"], "left").select("r", "v", "k", F.coalesce("to", "c").alias("c"), "scale", (F.col("turn") + 1).alias("turn")), "parts")
    return parts


def refined(graph: DataFrame, nodes: DataFrame, gamma: float, seed: int, rounds: int = MERGES) -> DataFrame:
    """(v, k, c, part), written: connected parts of the communities ``c`` of nodes (r, v, k, c).  Parts are
    named by one of their nodes."""
    total = nodes.agg(F.sum("k")).first()[0]
    label = lambda end, out, *more: nodes.select(F.col("v").alias(end), F.col("c").alias(out), *more).hint("merge")
    inner = graph.where("i <> j").join(label("i", "x", "k"), "i").join(label("j", "y"), "j").where("x = y")
    inner = written(inner.select("i", "j", "w", "x", "k"), "inner")
    sizes = inner.groupBy("x").agg(F.count("*").alias("m"))
    seen = sizes.agg(F.sum("m").alias("all"), F.max("m").alias("most")).first()
    large = sizes.where(F.col("m") > GROUP).select(F.col("x").alias("c")) if (seen["most"] or 0) > GROUP else None
    small = inner if large is None else inner.join(large.select(F.col("c").alias("x")).hint("merge"), "x", "left_anti")
    tasks = -(-(seen["all"] or 1) // GROUP)
    tasks = max(tasks, min(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(seen["all"] or 1) // 2000)))

    def refine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j"])
        ids, first = np.unique(rows["i"].to_numpy(np.int64), return_index=True)
        i, j = np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])
        found = settled(len(ids), i, j, rows["w"].to_numpy(float), gamma, np.random.default_rng([seed, *key]), np.arange(len(ids)), rows["x"].to_numpy(np.int64)[first], rows["k"].to_numpy(float)[first], total)
        part = connected(found, i, j)
        return pd.DataFrame({"v": ids, "part": ids[np.unique(part, return_index=True)[1][part]]})

    # Communities share a task, as most are small.
    found = small.withColumn("task", F.pmod(F.xxhash64("x"), F.lit(tasks))).groupBy("task").applyInPandas(refine, "v long, part long")
    if large is not None:
        rest = written(nodes.join(large.hint("merge"), "c", "left_semi").select("r", "v", "k", F.col("v").alias("c")), "large")
        found = found.unionByName(_merged(inner.join(large.select(F.col("c").alias("x")).hint("merge"), "x", "left_semi"), rest, total, gamma, seed, rounds).select("v", F.col("c").alias("part")))
    return written(nodes.select("v", "k", "c").join(found.hint("merge"), "v", "left").select("v", "k", "c", F.coalesce("part", "v").alias("part")), "refined")


def contracted(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """The graph, written, whose nodes are the parts of (v, part)."""
    at = lambda end: parts.select(F.col("v").alias(end), F.col("part").alias(f"{end}2")).hint("merge")
    return written(graph.join(at("i"), "i").join(at("j"), "j").groupBy(F.col("i2").alias("i"), F.col("j2").alias("j")).agg(F.sum("w").alias("w")), "contracted")


def shrunk(graph: DataFrame, gamma: float, seed: int, few: int, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(graph, places, communities): the graph contracted until it has at most ``few`` edges or no parts
    come together any more; (node_id, v) says which of its nodes a node went into, and (v, c) which
    community each of its nodes was in (both None where nothing was done).  ``communities`` (v, c) are
    those that nodes begin in, else each is its own."""
    places, level = None, 0
    while graph.count() > few:
        nodes = degrees(graph).withColumn("r", F.lit(0))
        if communities is None:
            nodes = nodes.withColumn("c", F.col("v"))
        else:
            nodes = nodes.join(communities.hint("merge"), "v")
        nodes = moved(graph, written(nodes.select("r", "v", "k", "c"), "nodes"), gamma, seed + 100 * level)
        parts = refined(graph, nodes, gamma, seed + 100 * level + 50)
        before, after = parts.count(), parts.select("part").distinct().count()
        if before == after:
            break
        graph = contracted(graph, parts)
        here = parts.select("v", "part")
        places = here.select(F.col("v").alias("node_id"), F.col("part").alias("v")) if places is None else written(places.join(here.hint("merge"), "v").select("node_id", F.col("part").alias("v")), "places")
        # A community is named by one of its parts.
        communities = parts.select(F.col("part").alias("v"), "c").distinct()
        names = communities.groupBy("c").agg(F.min("v").alias("name"))
        communities = written(communities.join(names.hint("merge"), "c").select("v", F.col("name").alias("c")), "communities")
        level += 1
    return graph, places, communities
