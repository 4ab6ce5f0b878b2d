"""Ranks and running sums that no single task has to make."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.blocked import written


def hash_key(*parts: Column) -> Column:
    """md5 of parts joined by colons: a shuffle that any engine can repeat."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


#: Rows of a group that one task ranks; larger groups are cut into slices.
LARGE = 1 << 16


def ranked(df: DataFrame, keys: Sequence[str], key: str, tie: str, name: str, size: str | None = None) -> DataFrame:
    """Adds ``name``, the rank from 1 of each row among rows of equal ``keys`` by an md5 ``key``.

    Rows are counted by the key's first two digits, so a group of any size is ranked by up to
    256 tasks instead of one; where the column ``size`` tells a group's rows, only large ones are
    cut.
    """
    cut = F.substring(key, 1, 2)
    sliced = df.withColumn("_slice", F.when(F.col(size) > LARGE, cut).otherwise("") if size else cut)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(key, tie))
    return sliced.withColumn("_own", own).join(counts, [*keys, "_slice"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_slice", "_own", "_before")


#: Ranges of values that running sums are made in; accuracy of the borders between them.
RANGES, ACCURACY = 64, 10_000


def running(df: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, str], descending: bool = False, own: bool = True) -> DataFrame:
    """Adds, for each (name, column) of ``sums``, the sum of the column over rows of equal ``by``
    whose ``value`` is at most the row's own (at least, if ``descending``; without ``own``, over
    the rows before it only).  Values are distinct within ``by`` and not null.

    A group's values are cut into ranges at approximate quantiles, so RANGES tasks share a group of
    any size; what lies before a range is a sum of its few predecessors' sums.  The rows are gone
    through several times, so they are written first.
    """
    df = written(df, "running")
    borders = F.percentile_approx(value, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(ACCURACY)).alias("_cuts")
    if by:
        cut = df.join(df.groupBy(*by).agg(borders), [*by])
    else:
        # One row.
        cut = df.join(F.broadcast(df.agg(borders)))
    cut = cut.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = cut.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    out = cut.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(totals, [*by, "_range"])
    return out.withColumns({n: F.col(f"_before_{n}") + F.col(f"_own_{n}") for n in sums}).drop("_range", *(f"_{k}_{n}" for n in sums for k in ("before", "own")))
