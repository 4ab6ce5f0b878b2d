"""Exact deduplication by distributed most-significant-digit radix partitioning.

A digit is a run of successive characters.  Each round groups the documents of a class by
their next digit; a group of one document is settled, and so is a group whose texts have
ended, whose members are then equal; the rest go on with the next, wider digit.  The length
is the leading digit, so a group ends for all members at once.  Nothing is hashed for
equality: rows meet by the characters themselves.

A round counts its groups with a map-side pre-aggregation and joins the groups of two or more
back, so a group that holds a third of all rows crosses the network as a few partial counts,
and the join splits its rows (adaptive skew join).  Documents alone with their first digit are
told apart by bits of fixed size before that, and never cross the network.  Digits widen eightfold, so the number of
rounds is logarithmic in the longest text, and only documents that still share a class with
another carry their text along.

Defined results: a null text counts as empty; case differs by A-Z only; of rows equal in both
id and text exactly one is kept; null ids are smaller than any other and rows of nothing but
null ids keep one row under a null keep_id; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import UPPER, marked, saved

FIRST, WIDER = 64, 8


def lowered(text: F.Column) -> F.Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def _single(rows: DataFrame, more: list[str]) -> DataFrame:
    return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *more)


def _rounds(docs: DataFrame, carried: list[str], whole: bool = False) -> DataFrame:
    """Every row with (keep_id, group_size, kept, sha) and the columns in ``carried``; with
    ``whole`` also its text, which else stays with documents that go on to the next round only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    start = docs.withColumn("len", F.octet_length(text).cast("long"))
    head = start.select("doc_id", "len", lowered(F.substring(text, 1, FIRST)).alias("digit"))
    active = start.select(
        "doc_id", "len", lowered(F.substring(text, 1, FIRST)).alias("digit"),
        F.sha2(lowered(text).cast("binary"), 256).alias("sha"), "text", *carried,
    )
    more = [*carried, "text"] if whole else carried
    settled: list[DataFrame] = []
    keys, done, width = ["len", "digit"], FIRST, FIRST
    while True:
        groups = saved(
            head.groupBy(*(F.col(k).alias(f"g_{k}") for k in keys))
            .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
            .where("n > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        if not settled:
            # Most documents share their first digits with no other; they need no shuffle.
            told = marked(active, F.xxhash64(*keys), groups, F.xxhash64(*(f"g_{k}" for k in keys)))
            settled.append(_single(told.where("not maybe"), more))
            active = told.where("maybe").drop("maybe")
        met = active.join(groups, reduce(F.Column.__and__, [F.col(k) == F.col(f"g_{k}") for k in keys]), "left")
        ended = F.col("len") <= done
        table = saved(
            met.select(
                "doc_id", "len", "sha", F.col("next").alias("cls"), "n", "keep",
                F.when(F.lit(whole) | (F.col("n").isNotNull() & ~ended), F.col("text")).alias("text"), *carried,
                F.when(F.col("n").isNull(), "single").when(ended, "ended").otherwise("active").alias("status"),
            ), "radix-round", by="status",
        )
        settled.append(_single(table.where("status = 'single'"), more))
        # Rows alike in all that is carried cannot be told apart, so they are counted and dealt out again.
        same = table.where("status = 'ended'").groupBy("cls", "doc_id", "n", "keep", "sha", *more).agg(F.count(F.lit(1)).alias("m"))
        stays = F.col("doc_id").eqNullSafe(F.col("keep"))
        if more:
            best = same.where(stays).groupBy(F.col("cls").alias("best_cls")).agg(F.min(F.struct(*more)).alias("best"))
            same = same.join(best, F.col("cls") == F.col("best_cls"), "left")
            stays = stays & F.struct(*more).eqNullSafe(F.col("best"))
        settled.append(
            same.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
            .select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (stays & (F.col("k") == 1)).alias("kept"), "sha", *more)
        )
        rest = table.where("status = 'active'")
        if rest.isEmpty():
            break
        width *= WIDER
        active = rest.select("doc_id", "len", lowered(F.substring("text", done + 1, width)).alias("digit"), "sha", "text", *carried, "cls")
        head, keys, done = active, ["cls", "digit"], done + width
    return reduce(DataFrame.unionAll, settled)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every document and its class."""
    out = _rounds(docs.select("doc_id", "text"), [])
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows alike in id and text fall to the
    smallest of their other columns."""
    names, others = docs.columns, [c for c in docs.columns if c != "text"]
    place = {c: f"p_{i}" for i, c in enumerate(others)}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(p) for c, p in place.items()))
    out = _rounds(plain, list(place.values()), whole=True).where("kept")
    return out.select(*(F.col("text") if c == "text" else F.col(place[c]).alias(c) for c in names))
