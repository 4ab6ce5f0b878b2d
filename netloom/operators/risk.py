"""Relative risks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.stats import normal_quantile
from netloom.operators.clean import finite


def _ratio(ne: Column, de: Column, nn: Column, dn: Column, alpha: float, variance: str) -> list[Column]:
    """rr, low and high from the numbers of exposed, of diseased among them, and the same unexposed."""
    d = lambda c: c.cast("double")
    ne, de, nn, dn = d(ne), d(de), d(nn), d(dn)
    zero = F.lit(0.0)
    rr = (de / F.nullif(ne, zero)) / F.nullif(dn / F.nullif(nn, zero), zero)
    if variance not in ("sum", "katz"):
        raise ValueError("variance must be 'sum' or 'katz'")
    last = (nn - dn) / F.nullif(dn + nn if variance == "sum" else dn * nn, zero)
    error = F.sqrt((ne - de) / F.nullif(de * ne, zero) + last)
    z = normal_quantile(1 - alpha / 2)
    log = F.ln(F.nullif(rr, zero))
    return [rr.alias("rr"), F.exp(log - z * error).alias("low"), F.exp(log + z * error).alias("high")]


def exposed(df: DataFrame, control: str, test: str, where: Column | None = None) -> DataFrame:
    """(exposed, diseased): pairs of finite values, as booleans, of the rows chosen."""
    rows = df.select(finite(control).alias("c"), finite(test).alias("t"), (F.lit(True) if where is None else where).alias("w"))
    return rows.where("w and c is not null and t is not null").select((F.col("c") != 0).alias("exposed"), (F.col("t") != 0).alias("diseased"))


def relative_risk(pairs: DataFrame, alpha: float = 0.05, variance: str = "sum") -> DataFrame:
    """(rr, low, high) of (exposed, diseased) rows.  ``sum`` adds diseased and all in the second
    error term, as analyses of this kind have done; ``katz`` multiplies them, as the textbook does."""
    e, d = F.col("exposed"), F.col("diseased")
    counts = pairs.agg(F.count_if(e).alias("ne"), F.count_if(e & d).alias("de"), F.count_if(~e).alias("nn"), F.count_if(~e & d).alias("dn"))
    return counts.select(*_ratio(F.col("ne"), F.col("de"), F.col("nn"), F.col("dn"), alpha, variance))


def risk_matrix(df: DataFrame, rows: Sequence[str], columns: Sequence[str] | None = None, alpha: float = 0.5, filters: Mapping[str, Mapping[str, Column]] | None = None, variance: str = "sum") -> DataFrame:
    """(exposure, disease, rr, low, high, significant) for all ordered pairs, in one pass.

    The diagonal is 1.  ``filters`` gives conditions by exposure and by disease or 'all'.
    """
    columns, filters = list(columns or rows), filters or {}
    names = list(dict.fromkeys([*rows, *columns]))
    place = {c: i for i, c in enumerate(names)}
    on = {(i, j): filters.get(i, {}).get("all", filters.get(i, {}).get(j)) for i in rows for j in columns}
    base = df.select(*(finite(c).alias(f"v{place[c]}") for c in names), *(F.coalesce(w, F.lit(False)).alias(f"w_{place[i]}_{place[j]}") for (i, j), w in on.items() if w is not None))
    wanted = []
    for (i, j), w in on.items():
        if i == j:
            continue
        a, b = F.col(f"v{place[i]}"), F.col(f"v{place[j]}")
        ok = a.isNotNull() & b.isNotNull() & (F.col(f"w_{place[i]}_{place[j]}") if w is not None else F.lit(True))
        at = f"{place[i]}_{place[j]}"
        wanted += [F.count_if(ok & (a != 0)).alias(f"ne_{at}"), F.count_if(ok & (a != 0) & (b != 0)).alias(f"de_{at}"), F.count_if(ok & (a == 0)).alias(f"nn_{at}"), F.count_if(ok & (a == 0) & (b != 0)).alias(f"dn_{at}")]
    sums = base.agg(*wanted) if wanted else base.agg(F.count(F.lit(1)).alias("n"))
    entry = lambda i, j: F.struct(F.lit(i).alias("exposure"), F.lit(j).alias("disease"), *(F.lit(None).cast("long").alias(k) if i == j else F.col(f"{k}_{place[i]}_{place[j]}").alias(k) for k in ("ne", "de", "nn", "dn")))
    each = sums.select(F.explode(F.array(*(entry(i, j) for i, j in on))).alias("e")).select("e.*")
    out = each.select("exposure", "disease", *_ratio(F.col("ne"), F.col("de"), F.col("nn"), F.col("dn"), alpha, variance))
    same = F.col("exposure") == F.col("disease")
    out = out.withColumns({c: F.when(same, 1.0).otherwise(F.col(c)) for c in ("rr", "low", "high")})
    return out.withColumn("significant", F.coalesce((F.col("low") > 1) | (F.col("high") < 1), F.lit(False)))
