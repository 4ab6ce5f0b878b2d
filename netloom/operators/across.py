"""Exact searches and kernel means between groups of points, by pairs of blocks.

A block holds points of one (grp, side); those of a block that asks meet the other sides of its grp.
The nearest box that holds enough points bounds how far answers can lie, a search there tightens the
bound for each point, and only blocks whose boxes come that near meet, each two under one key.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import blocked

PACKED = "block long, grp long, side long, ask boolean, n int, ids binary, x binary, low binary, high binary, w binary"
FOUND = "src long, dst long, here long, there long, d double"
#: Kernel weights below e^-40 of the largest are less than a double's rounding.
NEGLIGIBLE = 40.0
#: So few blocks all meet: bounds would save less work than finding them takes, and change no answer.
FEW = 32
#: Points of a leaf, at most; leaves of a chunk, whose points ask together; points that are split into leaves at a time.
LEAF, CHUNK, SPLIT = 256, 8, 1 << 16
#: Leaves that a point's first bound comes from, and that are searched at a time; leaves that a group meets, at most.
STEP, PIECE = 8, 2048
#: Exponents that a task holds at a time, and blocks whose sums it adds up before they are shuffled.
EXPONENTS, ADDED = 1 << 17, 4


def packed(points: DataFrame, axes: np.ndarray | None = None) -> DataFrame:
    """Points (grp, side, ask, id, v, w) in blocks, written.  ``axes`` turns v into the coordinates
    that are searched; w, an array or null, rides along."""
    spark = points.sparkSession
    ends = [F.percentile_approx(F.get("v", F.lit(j)), F.array(F.lit(0.001), F.lit(0.999)), 1000).alias(f"q{j}") for j in range(blocked.AXES)]
    seen = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), *ends).first()
    n, dim = seen["n"], seen["dim"] or 1
    size = max(1, min(blocked.BLOCK, blocked.BLOCK_BYTES // (8 * dim), max(64, -(-n // blocked.LEAST_BLOCKS))))
    box = [seen[f"q{j}"] for j in range(min(blocked.AXES, dim)) if seen[f"q{j}"]]
    deals = max(1, min(-(-n // size), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ("grp", "side", "code", "id")
    dealt = points.withColumn("code", blocked._curve([q[0] for q in box], [q[1] for q in box])).repartitionByRange(deals, *order).sortWithinPartitions(*order)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, rest = TaskContext.get().partitionId() << 32, None
        for frame in frames:
            whole = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            kinds = (whole[["grp", "side"]] != whole[["grp", "side"]].shift()).any(axis=1).cumsum().to_numpy()
            last = kinds[-1] if len(kinds) else 0
            rest = None
            for kind, own in whole.groupby(kinds, sort=True):
                for i in range(0, len(own), size):
                    part = own.iloc[i : i + size]
                    if kind == last and i + size >= len(own):
                        rest = part.reset_index(drop=True)  # Rows of its kind may follow.
                    else:
                        yield block(number, part)
                        number += 1
        if rest is not None:
            yield block(number, rest)

    def block(number: int, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_list()).astype(float)
        x = x if axes is None else x @ axes
        w = b"" if part["w"].iloc[0] is None else np.stack(part["w"].to_list()).astype(float).tobytes()
        first = part.iloc[0]
        return pd.DataFrame({
            "block": [number], "grp": [first["grp"]], "side": [first["side"]], "ask": [bool(first["ask"])], "n": [len(part)], "ids": [part["id"].to_numpy(np.int64).tobytes()],
            "x": [x.tobytes()], "low": [x.min(0).tobytes()], "high": [x.max(0).tobytes()], "w": [w],
        })

    return blocked.written(dealt.select("grp", "side", "ask", "id", "v", "w").mapInPandas(pack, PACKED), "across")


def _farthest(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """A bound on the squared distances of the points of two sets of boxes."""
    d = np.zeros((len(low), len(low2)))
    for j in range(low.shape[1]):
        gap = np.maximum(high[:, j, None] - low2[:, j], high2[:, j] - low[:, j, None])
        d += gap * gap
    return d * (1 + 1e-9)


def _compared(boxes: DataFrame, choose, schema: str) -> DataFrame:
    """``choose(askers, others)`` of some hundreds of a grp's boxes a side, each two sides under their own key."""
    counts = boxes.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(blocked.BOXES)).cast("int").alias("sides"))
    dealt = boxes.join(counts, "grp").withColumn("deal", F.pmod(F.xxhash64("block"), F.col("sides")).cast("int"))
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    askers = dealt.where("ask").select("*", F.col("deal").alias("g"), F.explode(every).alias("h"), F.lit(True).alias("asks"))
    others = dealt.select("*", F.explode(every).alias("g"), F.col("deal").alias("h"), F.lit(False).alias("asks"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return choose(rows[rows["asks"]].reset_index(drop=True), rows[~rows["asks"]].reset_index(drop=True))

    return askers.unionByName(others).groupBy("grp", "g", "h").applyInPandas(one, schema)


def _eligible(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    return (a["grp"].to_numpy()[:, None] == b["grp"].to_numpy()) & (a["side"].to_numpy()[:, None] != b["side"].to_numpy())


def _partners(own: DataFrame, k: int) -> DataFrame:
    """(a, b): for each asking block the eligible one of at least ``k`` points that is surely nearest."""

    def choose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["n"] >= k].reset_index(drop=True)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "far": np.zeros(0), "b": np.zeros(0, np.int64)})
        d = np.where(_eligible(a, b), _farthest(*blocked._boxes(a), *blocked._boxes(b)), np.inf)
        best = d.argmin(1)
        out = pd.DataFrame({"a": a["block"].to_numpy(np.int64), "far": d[np.arange(len(a)), best], "b": b["block"].to_numpy(np.int64)[best]})
        return out[np.isfinite(out["far"])]

    found = _compared(own.select("block", "grp", "side", "ask", "n", "low", "high"), choose, "a long, far double, b long")
    return found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", "m.b", "m.far")


def _meet(own: DataFrame, met: DataFrame, search, schema: str) -> DataFrame:
    """``search(asking block, other block)`` of all (a, b), each two in a group of their own."""
    ends = met.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("block"), F.lit(True).alias("asks")), F.struct(F.col("b").alias("block"), F.lit(False).alias("asks")))).alias("e"))
    rows = ends.select("a", "b", "e.block", "e.asks").join(own, "block")

    def both(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        return search(rows[asks].iloc[0], rows[~asks].iloc[0])

    return rows.groupBy("a", "b").applyInPandas(both, schema)


def _opened(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["x"]).reshape(len(ids), -1)


def _within(x: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Rows of x that come within their bound of a box."""
    gap = np.maximum(np.maximum(low - x, x - high), 0)
    d = gap.sum(1) if metric == "manhattan" else (gap * gap).sum(1) * (0.5 if metric == "cosine" else 1)
    return np.nonzero(d * (1 - 1e-9) <= bound)[0]


def bounded(own: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """Blocks with ``bound``, a distance (squared if Euclidean) for each point within which its ``k`` nearest lie, and
    ``reach``, the largest; written.  Both are null where no block alone holds ``k``
    points, and where there are few blocks."""
    if own.count() <= FEW:
        return own.withColumns({"bound": F.lit(None).cast("binary"), "reach": F.lit(None).cast("double")})

    def search(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        (a, x), (b, y) = _opened(one), _opened(two)
        d = np.empty(len(x))
        step = max(1, blocked.SLAB // len(y))
        for i in range(0, len(x), step):
            near, room = blocked.table(x[i : i + step], y, metric)
            d[i : i + step] = np.partition(near, k - 1, 1)[:, k - 1] + room
        return pd.DataFrame({"block": [int(one["block"])], "bound": [d.tobytes()], "reach": [float(d.max())]})

    bounds = _meet(own.select("block", "ids", "x"), _partners(own, k), search, "block long, bound binary, reach double")
    return blocked.written(own.join(bounds, "block", "left"), "bounded")


def _met(own: DataFrame, more: Mapping[int, float] | None = None, metric: str = "euclidean") -> DataFrame:
    """(a, b) of all blocks whose boxes come within the asking one's reach, widened by its grp's ``more``."""
    more = more or {}

    def choose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        reach = a["reach"].astype(float).fillna(np.inf).to_numpy() + np.array([more.get(int(g), 0.0) for g in a["grp"]])
        i, j = np.nonzero(_eligible(a, b) & (blocked.gaps(*blocked._boxes(a), *blocked._boxes(b), metric) <= reach[:, None]))
        return pd.DataFrame({"a": a["block"].to_numpy(np.int64)[i], "b": b["block"].to_numpy(np.int64)[j]})

    return _compared(own.select("block", "grp", "side", "ask", "low", "high", "reach"), choose, "a long, b long")


def nearest(own: DataFrame, k: int, itself: bool = False, metric: str = "euclidean") -> DataFrame:
    """(src, dst, here, there, d): of every asking point the ``k`` nearest of other sides, their sides and
    distances (squared if Euclidean; for the cosine vectors are packed at unit length); ties go to the
    smaller id.  No point finds its own id; with ``itself`` the other sides may hold it."""
    own = bounded(own, k + 1 if itself else k, metric)

    def search(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        (a, x), (b, y) = _opened(one), _opened(two)
        bound = np.full(len(a), np.inf) if one["bound"] is None else np.frombuffer(one["bound"])
        # Only points near the other block's box can have answers there, and only those near theirs are any.
        near = _within(x, bound, np.frombuffer(two["low"]), np.frombuffer(two["high"]), metric)
        a, x, bound = a[near], x[near], bound[near]
        if len(a):
            close = _within(y, np.full(len(y), bound.max()), x.min(0), x.max(0), metric)
            b, y = b[close], y[close]
        rows, ids, d = blocked.candidates(x, a, y, b, bound, k, metric)
        return pd.DataFrame({"src": a[rows.astype(np.int64)], "dst": ids.astype(np.int64), "here": np.int64(one["side"]), "there": np.int64(two["side"]), "d": d.astype(float)})

    found = _meet(own.select("block", "side", "ids", "x", "low", "high", "bound"), _met(own, metric=metric), search, FOUND)
    order = Window.partitionBy("src").orderBy("d", "dst")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


# ---- few components: leaves of all sides ---------------------------------------------------------

LEAVES = "leaf long, chunk long, n int, most long, rest int, first long, ids binary, sides binary, x binary, low binary, high binary, bound binary, reach double"


def _split(x: np.ndarray, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Rows ``at`` in leaves, halved along their longest side; equal values fall apart by id."""
    if len(at) <= LEAF:
        return [at]
    own = x[at]
    at = at[np.lexsort((ids[at], own[:, np.ptp(own, axis=0).argmax()]))]
    half = len(at) // 2
    return _split(x, ids, at[:half]) + _split(x, ids, at[half:])


class _Leaves:
    """Opened leaves: coordinates, ids, sides, bounds; boxes and smallest ids as arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids = [np.frombuffer(v, np.int64) for v in rows["ids"]]
        self.sides = [np.frombuffer(v, np.int64) for v in rows["sides"]]
        self.x = [np.frombuffer(v).reshape(len(a), -1) for v, a in zip(rows["x"], self.ids, strict=True)]
        self.low, self.high = blocked._boxes(rows)
        self.first = rows["first"].to_numpy(np.int64)


def _best(x: np.ndarray, side: np.ndarray, own: np.ndarray, bound: np.ndarray, leaves: _Leaves, k: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, side, squared distance) of each row's ``k`` nearest of other sides within its bound, ties to the
    smaller id.  The nearest leaves come first, and only those that can still hold answers; ``most`` stops after so many."""
    gap = blocked.gaps(x, x, leaves.low, leaves.high, "euclidean")
    order = np.lexsort((leaves.first, gap.min(0)))[:most]
    limit, last = bound.copy(), np.full(len(x), np.iinfo(np.int64).max)
    r, ids, sides, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    while len(order):
        near = gap[:, order]
        order = order[((near < limit[:, None]) | ((near == limit[:, None]) & (leaves.first[order] < last[:, None]))).any(0)]
        now, order = order[:STEP], order[STEP:]
        if not len(now):
            break
        y, b, t = (np.concatenate([v[i] for i in now]) for v in (leaves.x, leaves.ids, leaves.sides))
        new = blocked.table(x, y, "euclidean")[0]
        new[side[:, None] == t] = np.inf
        top = limit
        if k <= len(y) and not np.isfinite(limit).all():
            top = np.minimum(limit, np.partition(new, k - 1, 1)[:, k - 1])
        at, c = np.nonzero((new <= top[:, None]) & (new < np.inf))
        same = own[at] == b[c]
        at, c = at[~same], c[~same]
        r, ids, sides, d = np.concatenate([r, at]), np.concatenate([ids, b[c]]), np.concatenate([sides, t[c]]), np.concatenate([d, new[at, c]])
        by = np.lexsort((ids, d, r))
        r, ids, sides, d = r[by], ids[by], sides[by], d[by]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, ids, sides, d = r[keep], ids[keep], sides[keep], d[keep]
        count = np.bincount(r, minlength=len(x))
        end = np.cumsum(count) - 1
        full = np.flatnonzero(count == k)
        limit[full], last[full] = d[end[full]], ids[end[full]]
    return r, ids, sides, d


def leaves(points: DataFrame, k: int, axes: np.ndarray | None = None) -> DataFrame:
    """Points (id, side, v) in leaves of near ones, whatever their sides, written; with a bound on the squared
    distance of each point's ``k`` nearest of other sides, from near leaves, and the largest of these."""
    spark = points.sparkSession
    ends = [F.percentile_approx(F.get("v", F.lit(j)), F.array(F.lit(0.001), F.lit(0.999)), 1000).alias(f"q{j}") for j in range(blocked.AXES)]
    seen = points.agg(F.count("*").alias("n"), *ends).first()
    box = [q for q in (seen[f"q{j}"] for j in range(blocked.AXES)) if q]
    deals = max(1, min(-(-seen["n"] // (LEAF * CHUNK)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = points.withColumn("code", blocked._curve([q[0] for q in box], [q[1] for q in box])).repartitionByRange(deals, "code", "id").sortWithinPartitions("code", "id")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def built() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True)
            x, ids, sides = np.stack(whole["v"].to_list()).astype(float), whole["id"].to_numpy(np.int64), whole["side"].to_numpy(np.int64)
            x = x if axes is None else x @ axes
            rows = []
            for i, at in enumerate(_split(x, ids, np.arange(len(x)))):
                names, counts = np.unique(sides[at], return_counts=True)
                own = np.ascontiguousarray(x[at])
                rows.append({
                    "leaf": number + i, "chunk": (number + i) // CHUNK, "n": len(at), "most": names[counts.argmax()], "rest": len(at) - counts.max(), "first": ids[at].min(),
                    "ids": ids[at].tobytes(), "sides": sides[at].tobytes(), "x": own.tobytes(), "low": own.min(0).tobytes(), "high": own.max(0).tobytes(),
                })
            out = pd.DataFrame(rows)
            every, bounds = _Leaves(out), []
            for x, ids, sides in zip(every.x, every.ids, every.sides, strict=True):
                r, _, _, d = _best(x, sides, ids, np.full(len(x), np.inf), every, k, STEP)
                count = np.bincount(r, minlength=len(x))
                bounds.append(np.where(count == k, np.append(d, np.inf)[np.cumsum(count) - 1], np.inf))
            return out.assign(bound=[b.tobytes() for b in bounds], reach=[float(b.max()) for b in bounds])

        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= SPLIT:
                out = built()
                # Chunks do not cross what is split at a time.
                number, held, n = number + -(-len(out) // CHUNK) * CHUNK, [], 0
                for i in range(0, len(out), CHUNK):
                    yield out[i : i + CHUNK]
        if held:
            out = built()
            for i in range(0, len(out), CHUNK):
                yield out[i : i + CHUNK]

    own = blocked.written(dealt.select("id", "side", "v").mapInPandas(pack, LEAVES), "leaves")
    far = F.col("reach") == float("inf")
    return _reached(own, far, k) if own.where(far).limit(1).count() else own


def _reached(own: DataFrame, far: Column, k: int) -> DataFrame:
    """Leaves with bounds for those, too, which have too few points of other sides near them: from the leaf
    that is surely nearest and holds enough."""
    boxes = own.select(F.col("leaf").alias("block"), F.lit(0).alias("grp"), far.alias("ask"), "n", "most", "rest", F.when(far, F.col("sides")).alias("names"), "low", "high")

    def choose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "far": np.zeros(0), "b": np.zeros(0, np.int64)})
        most, rest = b["most"].to_numpy(np.int64), b["rest"].to_numpy(np.int64)
        many = b["n"].to_numpy(np.int64) - rest >= k
        usable = np.stack([(rest >= k) | (many & ~np.isin(most, np.frombuffer(v, np.int64))) for v in a["names"]])
        d = np.where(usable, _farthest(*blocked._boxes(a), *blocked._boxes(b)), np.inf)
        best = d.argmin(1)
        out = pd.DataFrame({"a": a["block"].to_numpy(np.int64), "far": d[np.arange(len(a)), best], "b": b["block"].to_numpy(np.int64)[best]})
        return out[np.isfinite(out["far"])]

    found = _compared(boxes, choose, "a long, far double, b long").groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("b"))

    def search(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        (_, x), (_, y) = _opened(one), _opened(two)
        d = blocked.table(x, y, "euclidean")[0]
        d[np.frombuffer(one["sides"], np.int64)[:, None] == np.frombuffer(two["sides"], np.int64)] = np.inf
        bound = np.minimum(np.frombuffer(one["bound"]), np.partition(d, k - 1, 1)[:, k - 1])
        return pd.DataFrame({"leaf": [int(one["block"])], "new": [bound.tobytes()], "to": [float(bound.max())]})

    bounds = _meet(own.select(F.col("leaf").alias("block"), "ids", "sides", "x", "bound"), found, search, "leaf long, new binary, to double")
    whole = own.join(bounds, "leaf", "left").withColumns({"bound": F.coalesce("new", "bound"), "reach": F.coalesce("to", "reach")})
    return blocked.written(whole.drop("new", "to"), "leaves")


def nearest_others(own: DataFrame, k: int) -> DataFrame:
    """(src, dst, here, there, d) of all points in ``leaves``: the ``k`` nearest of other sides, ties to the smaller id.
    The leaves that a chunk's boxes can reach are sent to it once; ``k`` a point come back."""
    boxes = own.select(F.col("leaf").alias("block"), "chunk", F.lit(0).alias("grp"), F.lit(True).alias("ask"), "low", "high", "reach")

    def choose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"chunk": np.zeros(0, np.int64), "leaf": np.zeros(0, np.int64)})
        i, j = np.nonzero(blocked.gaps(*blocked._boxes(a), *blocked._boxes(b), "euclidean") <= a["reach"].to_numpy(float)[:, None])
        return pd.DataFrame({"chunk": a["chunk"].to_numpy(np.int64)[i], "leaf": b["block"].to_numpy(np.int64)[j]}).drop_duplicates()

    met = blocked.written(_compared(boxes, choose, "chunk long, leaf long").distinct(), "met")
    pieces = met.groupBy("chunk").agg(F.ceil(F.count("*") / F.lit(PIECE)).cast("int").alias("pieces"))
    several = pieces.where("pieces > 1").limit(1).count() > 0
    columns = ("leaf", "first", "ids", "sides", "x", "low", "high", "bound")
    asked = own.join(pieces, "chunk").select("chunk", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("asks"), *columns)
    others = met.join(pieces, "chunk").withColumn("piece", F.pmod(F.xxhash64("leaf"), F.col("pieces")).cast("int")).join(own.drop("chunk"), "leaf").select("chunk", "piece", F.lit(False).alias("asks"), *columns)

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        out = [pd.DataFrame({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64), "here": np.zeros(0, np.int64), "there": np.zeros(0, np.int64), "d": np.zeros(0)})]
        if asks.all():
            return out[0]
        every, mine = _Leaves(rows[~asks]), rows[asks]
        opened = _Leaves(mine)
        for x, ids, sides, bound in zip(opened.x, opened.ids, opened.sides, mine["bound"], strict=True):
            r, dst, there, d = _best(x, sides, ids, np.frombuffer(bound), every, k)
            out.append(pd.DataFrame({"src": ids[r], "dst": dst, "here": sides[r], "there": there, "d": d}))
        return pd.concat(out)

    found = asked.unionByName(others).groupBy("chunk", "piece").applyInPandas(search, FOUND)
    if not several:
        return found
    order = Window.partitionBy("src").orderBy("d", "dst")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


# ---- kernel means --------------------------------------------------------------------------------


def kernel_means(own: DataFrame, widths: Mapping[int, float], dim: int) -> DataFrame:
    """(id, move): for every asking point the mean of the other side's w[:dim], weighted by w[dim] times
    exp(-squared distance / width of the grp).  What is left out weighs less than rounding."""
    # Boxes alone bound how far a point's nearest lies: most Gaussians are wide, so a search for it would save little.
    if own.count() > FEW:
        own = own.join(_partners(own, 1).select(F.col("a").alias("block"), F.col("far").alias("reach")), "block", "left")
    else:
        own = own.withColumn("reach", F.lit(None).cast("double"))
    widths = dict(widths)

    def added(one: pd.Series, others: pd.DataFrame) -> pd.DataFrame:
        """Sums of a block's points over some other blocks, each point's weights relative to its nearest there."""
        a, x = _opened(one)
        width = widths[int(one["grp"])]
        low, sums = np.full(len(a), np.inf), np.zeros((len(a), dim + 1))
        for _, two in others.sort_values("block").iterrows():
            b, y = _opened(two)
            w = np.frombuffer(two["w"]).reshape(len(b), -1)
            centre = y.mean(0)
            x2, y2 = (x - centre) / np.sqrt(width), (y - centre) / np.sqrt(width)
            # |x|^2 - |x - y|^2 in one product.
            left, right = np.c_[2 * x2, np.ones(len(x))], np.c_[y2, -(y2 * y2).sum(1)].T
            square, step = (x2 * x2).sum(1), max(1, EXPONENTS // len(y))
            for i in range(0, len(a), step):
                part = slice(i, i + step)
                e = left[part] @ right
                top = e.max(1)
                e -= top[:, None]
                np.exp(e, out=e)
                new = np.maximum(square[part] - top, 0)
                both = np.minimum(low[part], new)
                sums[part] = sums[part] * np.exp(both - low[part])[:, None] + (e @ w) * np.exp(both - new)[:, None]
                low[part] = both
        out = pd.DataFrame(sums, columns=names)
        out.insert(0, "m", low)
        out.insert(0, "id", a)
        return out

    names = [f"t{j}" for j in range(dim + 1)]
    met = _met(own, {g: NEGLIGIBLE * v for g, v in widths.items()})
    pieces = max(1, -(-own.where(~F.col("ask")).count() // ADDED))
    met = met.withColumn("piece", F.pmod(F.xxhash64("b"), F.lit(pieces)).cast("int"))
    ends = met.select("a", "piece", F.col("b").alias("block"), F.lit(False).alias("asks")).unionByName(met.select("a", "piece", F.col("a").alias("block"), F.lit(True).alias("asks")).distinct())
    # Few bytes are much work here, so groups are dealt by their number, not by their size.
    deals = 2 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.join(own.select("block", "grp", "ids", "x", "w"), "block").repartition(deals, "a", "piece")

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        return added(rows[asks].iloc[0], rows[~asks])

    found = rows.groupBy("a", "piece").applyInPandas(search, "id long, m double, " + ", ".join(f"{t} double" for t in names))
    sums = blocked.written(found, "sums")
    least = sums.groupBy("id").agg(F.min("m").alias("least"))
    scale = F.exp(F.col("least") - F.col("m"))
    whole = sums.join(least, "id").groupBy("id").agg(*(F.sum(F.col(t) * scale).alias(t) for t in names))
    return whole.select("id", F.array(*(F.col(t) / F.col(names[-1]) for t in names[:-1])).alias("move"))
