"""Differential markers between two groups, and the false discovery rate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import stats
from netloom.functions.ranks import running


def long(df: DataFrame, markers: Sequence[str], group: Column) -> DataFrame:
    """(marker, grp, value): a row per marker and observation; grp is 1 for the target, 0 for the
    reference; rows of neither and null values are left out."""
    wide = df.select(group.alias("grp"), *(F.col(f"`{m}`").cast("double").alias(m) for m in markers)).where(F.col("grp").isNotNull())
    return wide.unpivot("grp", [f"`{m}`" for m in markers], "marker", "value").where("value is not null").select("marker", F.col("grp").cast("int").alias("grp"), "value")


def sides(group: str, target, reference="other") -> Column:
    """1 for the target value, 0 for the reference: a value, a list, or 'other' for all the rest."""
    c = F.col(f"`{group}`")
    if isinstance(reference, str) and reference == "other":
        other = c != target
    else:
        other = c.isin(list(reference) if isinstance(reference, (list, tuple)) else [reference])
    return F.when(c == target, 1).when(other, 0)


def _values(rows: DataFrame) -> DataFrame:
    """(marker, value, n0, n1, upto0, upto1): counts by distinct value and running sums, which
    ranges of a marker's values share."""
    each = rows.groupBy("marker", "value").agg(F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1"))
    return running(each, ["marker"], "value", {"upto0": "n0", "upto1": "n1"})


def mann_whitney(rows: DataFrame) -> DataFrame:
    """(marker, n_tgt, n_ref, u, ties): the target's U statistic from mid-ranks, and the sum of
    t^3 - t over tied values.  Markers with an empty side are left out."""
    v = _values(rows).withColumn("t", F.col("n0") + F.col("n1"))
    rank = F.col("upto0") + F.col("upto1") - (F.col("t") - 1) / F.lit(2.0)
    sums = v.groupBy("marker").agg(F.sum("n1").alias("n_tgt"), F.sum("n0").alias("n_ref"), F.sum(F.col("n1") * rank).alias("r"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    sums = sums.where("n_tgt > 0 and n_ref > 0")
    return sums.select("marker", "n_tgt", "n_ref", (F.col("r") - F.col("n_tgt") * (F.col("n_tgt") + 1) / F.lit(2.0)).alias("u"), "ties")


def welch(rows: DataFrame) -> DataFrame:
    """(marker, t, df): null with fewer than two values on a side or no spread."""
    of = lambda f, g, name: f(F.when(F.col("grp") == g, F.col("value"))).alias(name)
    m = rows.groupBy("marker").agg(*(of(f, g, f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    m = m.where("n0 > 0 and n1 > 0").withColumn("a", F.col("v1") / F.col("n1")).withColumn("b", F.col("v0") / F.col("n0"))
    a, b = F.col("a"), F.col("b")
    df = (a + b) * (a + b) / F.nullif(a * a / F.nullif(F.col("n1") - 1, F.lit(0)) + b * b / F.nullif(F.col("n0") - 1, F.lit(0)), F.lit(0.0))
    return m.select("marker", ((F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(a + b), F.lit(0.0))).alias("t"), df.alias("df"))


def kolmogorov_smirnov(rows: DataFrame) -> DataFrame:
    """(marker, n_tgt, n_ref, d): the largest gap of the two distribution functions."""
    v = _values(rows)
    v = v.join(v.groupBy("marker").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")), "marker").where("t0 > 0 and t1 > 0")
    return v.groupBy("marker").agg(F.max("t1").alias("n_tgt"), F.max("t0").alias("n_ref"), F.max(F.abs(F.col("upto1") / F.col("t1") - F.col("upto0") / F.col("t0"))).alias("d"))


def mann_whitney_p(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided; exact without ties up to 8 values on either side, else normal with both corrections."""
    if min(n, m) <= 8 and ties == 0:
        return stats.mann_whitney_exact(u, n, m)
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
    return min(1.0, stats.normal_two_sided(max(0.0, (abs(u - n * m / 2) - 0.5) / sd))) if sd else 1.0


TESTS = {
    "Mann-Whitney": (mann_whitney, lambda r: mann_whitney_p(r["u"], r["n_tgt"], r["n_ref"], r["ties"])),
    "Welch": (welch, lambda r: stats.t_two_sided(r["t"], r["df"]) if r["t"] is not None and r["df"] else None),
    "Kolmogorov-Smirnov": (kolmogorov_smirnov, lambda r: stats.kolmogorov_two_sample(r["d"], r["n_tgt"], r["n_ref"])),
}


def fdr(pvals: DataFrame, p: str = "pval", out: str = "pval_corr", method: str = "indep") -> DataFrame:
    """Adjusted p-values: Benjamini-Hochberg, or Benjamini-Yekutieli for ``n`` / ``negcorr``.  The
    window sees one row per test."""
    every = pvals.where(F.col(p).isNotNull())
    order = Window.orderBy(F.col(p).asc())
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    ranked = every.withColumn("_i", F.row_number().over(order)).withColumn("_n", n)
    factor = F.lit(1.0)
    if method in ("n", "negcorr"):
        factor = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    elif method not in ("indep", "poscorr"):
        raise ValueError("method must be 'indep', 'poscorr', 'n' or 'negcorr'")
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_n") * factor / F.col("_i"))
    down = Window.orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_i", "_n", "_raw")


def find_markers(df: DataFrame, group: str, target, reference="other", markers: Sequence[str] | None = None, test: str = "Mann-Whitney", fdr_method: str | None = "indep") -> DataFrame:
    """(marker, pval[, pval_corr]) by ascending p.  One row per marker passes through Python."""
    markers = list(markers) if markers is not None else [c for c, t in df.dtypes if c != group and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    statistic, p = TESTS[test]
    reduced = statistic(long(df, markers, sides(group, target, reference)))
    value = F.udf(lambda r: p(r), T.DoubleType())
    out = reduced.select("marker", value(F.struct(*reduced.columns)).alias("pval"))
    return (fdr(out, method=fdr_method) if fdr_method else out).orderBy("pval", "marker")


def significant(coefs: DataFrame, low: str = "95% lower-bound", high: str = "95% upper-bound") -> DataFrame:
    """Rows whose interval lies on one side of 0."""
    a, b = F.col(f"`{low}`"), F.col(f"`{high}`")
    return coefs.where(((a < 0) & (b < 0)) | ((a > 0) & (b > 0)))
