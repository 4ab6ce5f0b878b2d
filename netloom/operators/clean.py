"""Cleaning, encoding and derived variables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import across, blocked

#: Distinct rows of a block that imputation pairs with others.
BLOCK = 2000
#: Patterns of gaps that are searched two by two.
PATTERNS = 16


def finite(column: str) -> Column:
    """The value as a double, null unless finite."""
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clean(df: DataFrame, columns: Sequence[str], method: str = "mixed", thresh: float = 1, axis: int = 0, categorical: Sequence[str] = ()) -> tuple[DataFrame, DataFrame | list[str]]:
    """(cleaned table, selector).  Values that aren't finite become null; ``drop`` and ``mixed`` drop
    columns (axis 0) or rows (axis 1) with more than ``thresh`` of them, relative to the other
    dimension up to 1; ``knn`` and ``mixed`` then impute.  The selector lists the columns kept, or
    adds ``selected`` to all rows."""
    table = df.withColumns({c: finite(c) for c in columns})
    kept: list[str] = list(columns)
    selector: DataFrame | list[str] = kept
    if method in ("drop", "mixed"):
        if axis == 0:
            row = table.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(columns))).first()
            most = thresh * row["_n"] if 0 < thresh <= 1 else thresh
            selector = kept = [c for i, c in enumerate(columns) if row[f"_{i}"] <= most]
            table = table.drop(*(set(columns) - set(kept)))
        else:
            most = thresh * len(columns) if 0 < thresh <= 1 else thresh
            nulls = reduce(Column.__add__, (F.col(f"`{c}`").isNull().cast("int") for c in columns))
            selector = table.withColumn("selected", nulls <= F.lit(float(most)))
            table = selector.where("selected").drop("selected")
    if method in ("knn", "mixed"):
        table = impute(table, kept, categorical=categorical)
    return table, selector


def _near(x: np.ndarray, donors: np.ndarray, copies: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, column, donors, distances) of each missing value: the nearest donors, by the values both
    have, that make up k rows with their copies."""
    have = ~np.isnan(donors)
    filled = np.where(have, donors, 0)
    for i in range(len(x)):
        own = ~np.isnan(x[i])
        both = have & own
        n = both.sum(1)
        d = np.where(both, (filled - np.where(own, x[i], 0)) ** 2, 0).sum(1)
        d = np.where(n > 0, np.sqrt(d * x.shape[1] / np.maximum(n, 1)), np.inf)
        for j in np.flatnonzero(~own):
            some = np.flatnonzero(have[:, j] & np.isfinite(d))
            near = some[np.argsort(d[some], kind="stable")[:k]]
            near = near[: np.searchsorted(np.cumsum(copies[near]), k) + 1]
            yield i, int(j), near, d[near]


def impute(df: DataFrame, columns: Sequence[str], k: int = 5, categorical: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with means of the ``k`` nearest of all rows by inverse distance, or the column's mean
    where no row compares; categorical columns are rounded.

    Equal rows are one with a count.  Rows with gaps search the rows of each other pattern of gaps, or
    meet all rows where there are more than PATTERNS patterns; the nearest of what is found fill a gap.
    Ties go to the smaller md5.
    """
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    key = F.md5(F.concat_ws(",", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)).cast("binary"))
    rows = df.select(key.alias("key"), F.array(*values).alias("x")).groupBy("key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    # Numbers follow the md5 and are kept.
    rows = blocked.written(rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id()), "distinct")
    means = df.agg(*(F.avg(v) for v in values)).first()
    pattern = F.transform("x", lambda v: v.isNotNull())
    patterns = [tuple(r["p"]) for r in rows.select(pattern.alias("p")).distinct().limit(PATTERNS + 1).collect()]
    infinite = rows.where(F.exists("x", lambda v: F.abs(v) == float("inf")))
    filled = _paired(rows, k) if len(patterns) > PATTERNS or not infinite.isEmpty() else _searched(rows, patterns, k)
    filled = filled.groupBy(F.col("key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_filled"))
    # Maps are longer than they are taken for, so they are not broadcast.
    joined = df.withColumn("_own", key).join(filled.hint("merge"), F.col("_own") == F.col("_key"), "left")
    new = {c: F.coalesce(v, F.element_at("_filled", F.lit(i)), F.lit(means[i]).cast("double")) for i, (c, v) in enumerate(zip(columns, values, strict=True))}
    return joined.withColumns({c: F.rint(v) if c in categorical else v for c, v in new.items()}).select(*(F.col(f"`{c}`") for c in df.columns))


def _searched(rows: DataFrame, patterns: Sequence[tuple[bool, ...]], k: int) -> DataFrame:
    """(key, j, v) of the gaps of distinct rows.  Rows with one pattern of gaps search those with another in
    the columns that both have, by near blocks (``across``); of equal donors the first ``k`` will do."""
    spark = rows.sparkSession
    meets, scales, gaps = [], {}, []
    for g in patterns:
        for h in patterns:
            common, lacking = [a and b for a, b in zip(g, h, strict=True)], [j for j, (a, b) in enumerate(zip(g, h, strict=True)) if b and not a]
            if any(common) and lacking:
                grp = len(scales)
                scales[grp] = len(g) / sum(common)
                meets += [(list(g), grp, True, common), (list(h), grp, False, common)]
                gaps.append((grp, lacking))
    empty = "key string, j int, v double"
    if not meets:
        return spark.createDataFrame([], empty)
    # A row for each two patterns.
    meeting = spark.createDataFrame(meets, "pattern array<boolean>, grp long, ask boolean, common array<boolean>")
    projected = F.zip_with("x", "common", lambda v, c: F.when(c, v).otherwise(0.0))
    points = rows.withColumn("pattern", F.transform("x", lambda v: v.isNotNull())).join(F.broadcast(meeting), "pattern").select("grp", F.when(F.col("ask"), 0).otherwise(1).cast("long").alias("side"), "ask", "id", projected.alias("v"), F.lit(None).cast("array<double>").alias("w"))
    place = F.row_number().over(Window.partitionBy("grp", "v").orderBy("id"))
    donors = points.where(~F.col("ask")).withColumn("place", place).where(F.col("place") <= k).drop("place")
    own = across.bounded(across.packed(points.where("ask").unionByName(donors)), k)

    def search(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        (a, x), (b, y) = across._opened(one), across._opened(two)
        bound = np.full(len(a), np.inf) if one["bound"] is None else np.frombuffer(one["bound"])
        near = across._within(x, bound, np.frombuffer(two["low"]), np.frombuffer(two["high"]))
        a, x, bound = a[near], x[near], bound[near]
        if len(a):
            close = across._within(y, np.full(len(y), bound.max()), x.min(0), x.max(0))
            b, y = b[close], y[close]
        src, dst, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(1, blocked.SLAB // max(1, len(y)))
        for i in range(0, len(a) if len(b) else 0, step):
            d, room = blocked.table(x[i : i + step], y, "euclidean")
            limit = np.minimum(bound[i : i + step], np.partition(d, k - 1, 1)[:, k - 1]) if k <= len(b) else bound[i : i + step]
            # Squares a little apart may have the same root.
            r, c = np.nonzero(d <= ((limit + room) * (1 + 1e-12))[:, None])
            e = np.sqrt(blocked.exact(x[i + r], y[c], "euclidean") * scales[int(one["grp"])])
            order = np.lexsort((b[c], e, r))
            r, c, e = r[order], c[order], e[order]
            keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(x[i : i + step])))[r] < k
            src.append(a[i + r[keep]])
            dst.append(b[c[keep]])
            ds.append(e[keep])
        return pd.DataFrame({"grp": np.int64(one["grp"]), "src": np.concatenate(src), "dst": np.concatenate(dst), "d": np.concatenate(ds)})

    found = across._meet(own.select("block", "grp", "ids", "x", "low", "high", "bound"), across._met(own), search, "grp long, src long, dst long, d double")
    lacking = spark.createDataFrame(gaps, "grp long, js array<int>")
    given = rows.select(F.col("id").alias("dst"), "x", "n")
    each = found.join(F.broadcast(lacking), "grp").join(given, "dst").select("src", F.explode("js").alias("j"), "d", "dst", "x", "n").select("src", "j", F.struct("d", "dst", F.get("x", F.col("j")).alias("v"), F.least("n", F.lit(k)).alias("n")).alias("e"))
    near = each.groupBy("src", "j").agg(F.array_sort(F.collect_list("e")).alias("near"))

    def add(s: Column, e: Column) -> Column:
        times = F.least(e["n"], s["left"])
        zero = F.get("near", F.lit(0))["d"] == 0
        w = times * F.when(zero, F.when(e["d"] == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.nullif(e["d"], F.lit(0.0)))
        return F.struct((s["left"] - times).alias("left"), (s["w"] + w).alias("w"), (s["wv"] + w * e["v"]).alias("wv"))

    start = F.struct(F.lit(k).cast("long").alias("left"), F.lit(0.0).alias("w"), F.lit(0.0).alias("wv"))
    settled = near.select("src", "j", F.aggregate("near", start, add, lambda s: s["wv"] / s["w"]).alias("v"))
    return settled.join(rows.select(F.col("id").alias("src"), "key"), "src").select("key", "j", "v")


def _paired(rows: DataFrame, k: int) -> DataFrame:
    """The same where gaps have many patterns: all blocks of rows with gaps meet all blocks of rows."""
    spark, rows = rows.sparkSession, rows.select("key", "x", "n")
    gap = F.exists("x", lambda v: v.isNull())
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(gap).alias("gaps")).first()
    n_all, n_gaps = (max(-(-int(sizes[c]) // BLOCK), 1) for c in ("all", "gaps"))
    packed = lambda t, n, name: t.groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).alias(f"{name}_block")).agg(F.sort_array(F.collect_list(F.struct("key", "x", "n"))).alias(name))
    pairs = packed(rows.where(gap), n_gaps, "a").crossJoin(packed(rows, n_all, "b")).repartition(min(n_gaps * n_all, 10_000), "a_block", "b_block")

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                x, donors = (np.array([list(r["x"]) for r in side], float) for side in (a, b))
                copies = np.array([r["n"] for r in b])
                out = [(a[i]["key"], j, float(d), b[at]["key"], float(donors[at, j]), int(copies[at])) for i, j, near, dist in _near(x, donors, copies, k) for at, d in zip(near, dist, strict=True)]
                yield pd.DataFrame(out, columns=["key", "j", "d", "donor", "v", "n"])

    def settled(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (name, j), g in frame.sort_values(["key", "j", "d", "donor"]).groupby(["key", "j"], sort=False):
            copies = np.minimum(g["n"].to_numpy(), k)
            d, v = (np.repeat(g[c].to_numpy(), copies)[:k] for c in ("d", "v"))
            w = (d == 0).astype(float) if (d == 0).any() else 1 / d
            out.append((name, j, (w * v).sum() / w.sum()))
        return pd.DataFrame(out, columns=["key", "j", "v"])

    found = pairs.mapInPandas(nearest, "key string, j int, d double, donor string, v double, n long")
    deal = F.pmod(F.xxhash64("key"), F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_gaps)))
    return found.groupBy(deal).applyInPandas(settled, "key string, j int, v double")


def dummies(df: DataFrame, columns: dict[str, Sequence], thresh: float = 0, drop_first: bool = True) -> DataFrame:
    """0/1 columns ``{column}_{value}`` that are null where the value is; a column with fewer than
    ``thresh`` values present is dropped (relative to all rows up to 1); of two values the first has
    no column.  ``columns`` gives each column's values in order."""
    names = list(columns)
    if thresh:
        row = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names))).first()
        least = thresh * row["_n"] if thresh <= 1 else thresh
        dropped = [c for i, c in enumerate(names) if row[f"_{i}"] < least]
    else:
        dropped = []
    kept = [c for c in names if c not in dropped]
    values = {c: list(columns[c])[1:] if drop_first and len(columns[c]) == 2 else list(columns[c]) for c in kept}
    new = [F.when(F.col(f"`{c}`").isNotNull(), (F.col(f"`{c}`") == v).cast("int")).alias(f"{c}_{v}") for c in kept for v in values[c]]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), *new)


def binarize(column: Column, zero, one) -> Column:
    """0 where the column is ``zero``, 1 where it is ``one``, other values as they are (as text, if
    they are text)."""
    bit = str if isinstance(zero, str) or isinstance(one, str) else int
    return F.when(column == zero, F.lit(bit(0))).when(column == one, F.lit(bit(1))).otherwise(column)


def median_split(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Boolean columns ``> med( column )``."""
    medians = df.agg(*(F.median(F.col(f"`{c}`").cast("double")).alias(f"_m_{i}") for i, c in enumerate(columns)))
    new = [(F.col(f"`{c}`").cast("double") > F.col(f"_m_{i}")).alias(f"> med( {c} )") for i, c in enumerate(columns)]
    return df.join(F.broadcast(medians)).select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *new)


def extract(df: DataFrame, y: str, values: Sequence | None = None, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), as_binary: bool = True) -> DataFrame:
    """The columns and ``y`` of rows whose y is among ``values``; two values become 0 and 1."""
    rows = df.where(F.col(f"`{y}`").isin(list(values))) if values is not None else df.where(F.col(f"`{y}`").isNotNull())
    names = list(columns) if columns is not None else [c for c in df.columns if c != y and c not in exclude]
    target = binarize(F.col(f"`{y}`"), *values).cast("int") if values is not None and len(values) == 2 and as_binary else F.col(f"`{y}`")
    return rows.select(*(F.col(f"`{c}`") for c in names), target.alias(y))


def composed(df: DataFrame, columns: Sequence[str], method: str = "proportion", order: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """``proportion``: a / (a + b) for each pair; ``ratio``: a / b, and of order 2 the ratios of
    ratios over four columns in order.  Division by 0 gives null."""
    c = {x: F.col(f"`{x}`").cast("double") for x in columns}
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    if method == "proportion":
        new = [over(c[a], c[a] + c[b]).alias(f"{a} / ( {a} + {b} )") for a, b in combinations(columns, 2)]
    elif method == "ratio":
        new = [over(c[a], c[b]).alias(f"{a} / {b}") for a, b in combinations(columns, 2)]
        if order == 2:
            new += [over(over(c[p], c[q]), over(c[r], c[s])).alias(f"({p} / {q}) / ({r} / {s})") for p, q, r, s in combinations(columns, 4)]
    else:
        raise ValueError("method must be 'proportion' or 'ratio'")
    return df.select(*keep, *new)
