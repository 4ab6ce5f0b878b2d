"""Survival: log-rank scan of thresholds, Kaplan-Meier curves, concordance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import stats
from netloom.functions.ranks import running
from netloom.operators.blocked import written


def _at_risk(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, time, d1, n1, d, n): events and those at risk at each distinct time, in group 1 and in all."""
    each = rows.groupBy(*by, "time").agg(
        F.count_if(F.col("event") & (F.col("grp") == 1)).alias("d1"), F.count_if(F.col("event")).alias("d"),
        F.count_if(F.col("grp") == 1).alias("c1"), F.count(F.lit(1)).alias("c"),
    )
    return running(each, by, "time", {"n1": "c1", "n": "c"}, descending=True).select(*by, "time", "d1", "d", "n1", "n")


def logrank(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, gap, variance, chi2): observed less expected events of group 1; null without spread."""
    risk = _at_risk(rows, by)
    d1, n1, d, n = (F.col(c).cast("double") for c in ("d1", "n1", "d", "n"))
    gap = d1 - d * n1 / n
    var = F.when(F.col("n") > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    sums = risk.groupBy(*by).agg(F.sum(gap).alias("gap"), F.sum(var).alias("variance"))
    return sums.withColumn("chi2", F.col("gap") * F.col("gap") / F.nullif("variance", F.lit(0.0)))


def scan_thresholds(df: DataFrame, variable: str, duration: str, event: str, percentiles: Sequence[int] = tuple(range(10, 91, 10))) -> DataFrame:
    """(percentile, threshold, gap, variance, chi2): the log-rank statistic of ``> threshold`` against
    the rest at each percentile (linear interpolation)."""
    base = df.select(F.col(variable).cast("double").alias("v"), F.col(duration).cast("double").alias("time"), (F.col(event).cast("int") != 0).alias("event")).na.drop()
    cuts = base.agg(F.percentile("v", F.array(*(F.lit(p / 100) for p in percentiles))).alias("q")).select(F.posexplode("q").alias("i", "threshold"))
    # As many rows as percentiles.
    cuts = cuts.select(F.get(F.array(*map(F.lit, percentiles)), "i").alias("percentile"), "threshold")
    each = base.join(F.broadcast(cuts)).withColumn("grp", (F.col("v") > F.col("threshold")).cast("int"))
    return logrank(each, ["percentile", "threshold"])


def best_threshold(df: DataFrame, variable: str, duration: str, event: str, percentiles: Sequence[int] = tuple(range(10, 91, 10))) -> DataFrame:
    """(percentile, threshold, pval) with the smallest p; the first of equals; undefined ones last."""
    p = F.udf(lambda x: None if x is None else stats.chi2_one(x), T.DoubleType())
    return scan_thresholds(df, variable, duration, event, percentiles).withColumn("pval", p("chi2")).orderBy(F.col("chi2").desc_nulls_last(), "percentile").limit(1).select("percentile", "threshold", "pval")


def kaplan_meier(df: DataFrame, variable: str, duration: str, event: str, threshold: float, alpha: float = 0.05) -> DataFrame:
    """(above, time, n, d, survival, low, high): curves above the threshold and not, with Greenwood's
    interval of the log-log scale."""
    base = df.select((F.col(variable).cast("double") > threshold).alias("above"), F.col(duration).cast("double").alias("time"), (F.col(event).cast("int") != 0).alias("event")).na.drop().withColumn("grp", F.lit(1))
    risk = _at_risk(base, ["above"])
    n, d = F.col("n").cast("double"), F.col("d").cast("double")
    terms = {"_end": F.when(F.col("d") == F.col("n"), 1).otherwise(0), "_log": F.coalesce(F.ln(F.nullif(1 - d / n, F.lit(0.0))), F.lit(0.0)), "_term": F.coalesce(d / F.nullif(n * (n - d), F.lit(0.0)), F.lit(0.0))}
    sums = running(risk.withColumns(terms), ["above"], "time", {"_gone": "_end", "_ln": "_log", "_g": "_term"})
    gone = F.col("_gone") > 0
    curve = sums.select("above", "time", "n", "d", F.when(gone, 0.0).otherwise(F.exp("_ln")).alias("survival"), F.when(~gone, F.col("_g")).alias("_g"))
    z = stats.normal_quantile(1 - alpha / 2)
    theta = z * F.sqrt("_g") / F.nullif(F.ln(F.nullif("survival", F.lit(0.0))), F.lit(0.0))
    bound = lambda sign: F.when(F.col("survival").between(1e-300, 1 - 1e-15), F.pow("survival", F.exp(sign * -theta))).otherwise(F.col("survival"))
    return curve.select("above", "time", "n", "d", "survival", bound(1).alias("low"), bound(-1).alias("high"))


def hazard_table(coefs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(variable, coef, se, hr, low, high), by coefficient, from (variable, coef, se)."""
    z = stats.normal_quantile(1 - alpha / 2)
    return coefs.select("variable", "coef", "se", F.exp("coef").alias("hr"), F.exp(F.col("coef") - z * F.col("se")).alias("low"), F.exp(F.col("coef") + z * F.col("se")).alias("high")).orderBy("coef")


#: Ranges of times and of scores that pairs are counted by, at least and at most; cells of a range.
RANGES, MOST_RANGES, CELLS = 16, 1024, 65_536


class _Counts:
    """Sums of counts before a place, by halving steps."""

    def __init__(self, n: int) -> None:
        self.sums = [0] * (n + 1)

    def add(self, at: int, n: int) -> None:
        at += 1
        while at < len(self.sums):
            self.sums[at] += n
            at += at & -at

    def before(self, at: int) -> int:
        n = 0
        while at:
            n += self.sums[at]
            at &= at - 1
        return n


def _in_times(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs within a range of times: by falling time, those later with smaller and with equal scores."""
    rank = np.unique(rows["s"], return_inverse=True)[1].tolist()
    counts, concordant, tied, held, all_, comparable = _Counts(max(rank, default=0) + 1), 0, 0, {}, 0, 0
    rows = rows.assign(rank=rank).sort_values(["t", "k"], ascending=False)
    for _, own in rows.groupby(["t", "k"], sort=False):
        ranks, ns = own["rank"].tolist(), own["n"].tolist()
        if own["k"].iloc[0] == 0:
            for r, n in zip(ranks, ns, strict=True):
                concordant += n * counts.before(r)
                tied += n * held.get(r, 0)
                comparable += n * all_
        for r, n in zip(ranks, ns, strict=True):
            counts.add(r, n)
            held[r] = held.get(r, 0) + n
            all_ += n
    return pd.DataFrame({"concordant": [concordant], "tied": [tied], "comparable": [comparable]})


def _in_scores(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs within a range of scores whose times lie in different ranges: by rising score."""
    places, at = np.unique(rows["tr"], return_inverse=True)
    m = len(places)
    counts, concordant, tied = _Counts(m), 0, 0
    rows = rows.assign(at=m - 1 - at).sort_values("s")
    for _, own in rows.groupby("s", sort=False):
        ats, ns, events = own["at"].tolist(), own["n"].tolist(), (own["k"] == 0).tolist()
        same = _Counts(m)
        for a, n in zip(ats, ns, strict=True):
            same.add(a, n)
        for a, n, e in zip(ats, ns, events, strict=True):
            if e:
                concordant += n * counts.before(a)
                tied += n * same.before(a)
        for a, n in zip(ats, ns, strict=True):
            counts.add(a, n)
    return pd.DataFrame({"concordant": [concordant], "tied": [tied], "comparable": [0]})


def concordances(df: DataFrame, score: str, duration: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, concordant, tied, comparable, cindex): Harrell's index of a risk score in each group.

    Observations are counted by distinct (time, event, score) first.  A pair compares if the event
    comes first, or at the same time as a censoring.  Pairs in different ranges of times and scores
    are counted by ranges; those within a range of times, and those within a range of scores, in
    that range's task.  Values that border ranges are ranges of their own, which need no task, so
    frequent times and scores don't either.
    """
    rows = df.select(*by, F.col(score).cast("double").alias("s"), F.col(duration).cast("double").alias("t"), (F.col(event).cast("int") == 0).cast("int").alias("k")).na.drop(subset=["s", "t", "k"])
    cells = written(rows.groupBy(*by, "t", "k", "s").agg(F.count(F.lit(1)).alias("n")), "cells")
    size = cells.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    parts = min(MOST_RANGES, max(RANGES, -(-size // CELLS)))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = cells.groupBy(*by).agg(*(F.array_distinct(F.percentile_approx(c, shares, 10 * parts)).alias(f"{c}_cuts") for c in ("t", "s")))
    # One row a group, of fixed size.
    met = cells.join(F.broadcast(cuts), [*by]) if by else cells.join(F.broadcast(cuts))
    below = lambda c: F.size(F.filter(f"{c}_cuts", lambda v: v < F.col(c)))
    at = lambda c: F.array_contains(f"{c}_cuts", F.col(c))
    placed = met.withColumn("tr", 3 * below("t") + F.when(at("t"), 1 + F.col("k")).otherwise(0)).withColumn("sr", 2 * below("s") + at("s").cast("int")).drop("t_cuts", "s_cuts")
    placed = written(placed, "placed")
    schema = ", ".join([*(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in by), "concordant long, tied long, comparable long"])

    def keyed(count):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = count(rows)
            for i, c in enumerate(by):
                out.insert(i, c, [key[i]])
            return out

        return run

    near = placed.where("tr % 3 = 0").groupBy(*by, "tr").applyInPandas(keyed(_in_times), schema)
    near = near.unionByName(placed.where("sr % 2 = 0").groupBy(*by, "sr").applyInPandas(keyed(_in_scores), schema))
    # Ranges' counts, a table of fixed size: those of events against those of all in later ranges.
    table = placed.groupBy(*by, "tr", "sr").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("d"))
    far = table.groupBy(*by).applyInPandas(keyed(_far), schema) if by else table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda key, rows: keyed(_far)((), rows), schema)
    every = near.unionByName(far)
    total = every.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("concordant", "tied", "comparable")))
    return total.withColumn("cindex", (F.col("concordant") + F.col("tied") / F.lit(2.0)) / F.nullif("comparable", F.lit(0)))


def _far(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs in different ranges of times, but those within one range of scores of several values."""
    tr, sr = (np.unique(rows[c], return_inverse=True) for c in ("tr", "sr"))
    n, d = np.zeros((len(tr[0]), len(sr[0])), np.int64), np.zeros((len(tr[0]), len(sr[0])), np.int64)
    n[tr[1], sr[1]], d[tr[1], sr[1]] = rows["n"], rows["d"]
    later = np.cumsum(n[::-1], 0)[::-1] - n
    smaller = np.cumsum(later, 1) - later
    return pd.DataFrame({"concordant": [int((d * smaller).sum())], "tied": [int((d * later)[:, sr[0] % 2 == 1].sum())], "comparable": [int((d * later.sum(1)[:, None]).sum())]})


def concordance(df: DataFrame, score: str, duration: str, event: str) -> DataFrame:
    """(concordant, tied, comparable, cindex): Harrell's index of a risk score over all rows."""
    return concordances(df, score, duration, event)
