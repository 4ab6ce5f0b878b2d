"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are shuffled (by md5 of the id) into one stream of words, which is cut
into blocks of equal length and may be read twice.  A schedule of slots maps the golden-ratio
sequence frac((i + 1/2) phi) through the cumulative target weights, so every stretch of the
schedule holds the sources close to their targets; a slot takes its source's next block: slots
are ranked per source and join the blocks of that rank.  What a document gives is its overlap
with the blocks taken, at most twice its size, since no target exceeds twice its source.

No window runs over a whole source: positions come from sums per (source, slice of the shuffle)
and a running sum within the slice; ranks likewise from counts per (source, segment of slots).
A block has at least ``BLOCK`` words and grows with the corpus so that the schedule stays below
``SLOTS`` slots per corpus pass; a target is then met to a few blocks.

``mixed`` gives whole documents in the order of the schedule: a document stands at the slot that
reads the block of its first word, once for each reading.  It reads a source whose target is below
FEW blocks up to its target instead, since no slot may fall to it, and spreads it evenly.

Words are counted in one pass that leaves a short table; all but the documents of ``mixed`` comes
from that.

Defined results: a null or empty text has size 0 and gives nothing; null is a source, the last
in order; ids order the shuffle as text, null as the empty text; rows that agree in source, id
and size are interchangeable, and each counts; texts of any length are counted whole; other columns
are carried under other names, so theirs may be any; a corpus without words has targets of 0 and
an empty table no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import WORD_SQL, partitions, saved

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's words for each word of the corpus, and the most a source may repeat.
SHARE, REPEAT = 1.5, 2
BLOCK, SLOTS = 64, 1 << 24
#: Targets of fewer blocks are met by the word in ``mixed``.
FEW = 4
#: Fractional part of the golden ratio.
PHI = 0.6180339887498949
#: Cells of the unit interval that slots and targets meet in; slots that a segment ranks.
CELLS, SEGMENT = 4096, 65536
SEED = "mix"


def _sized(docs: DataFrame, carried: list[str]) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}")).cast("binary"))
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    # A key without nulls, so that windows and joins share one partitioning.
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", source.alias("source"), words.alias("size"), key.alias("key"), *carried).withColumn("slice", F.substring("key", 1, 3))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, lo, hi, total, block): one row per source, named by "=" and its
    name, or "" for null.

    ``lo``..``hi`` is the source's part of the unit interval.  Targets share SHARE of all words by
    weight and stop at REPEAT times the source's size; the excess goes to the others by weight.
    """
    order = Window.orderBy(F.col("source") == "", "source")
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over all sources: one short row each, after the sum.
    each = each.withColumn("place", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    each = each.withColumn("w", weight).withColumn("cap", F.col("source_size") * REPEAT)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Water filling: sources reach their caps in order of cap / weight.  Ten is a multiple of all weights.
    level = Window.orderBy((F.col("cap") * F.expr("10 div w")).asc(), F.col("place").asc())
    each = (
        each.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("w_left", F.sum("w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("cap_gone", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rate", (F.lit(SHARE) * F.col("total").cast("double") - F.col("cap_gone").cast("double")) / F.col("w_left").cast("double"))
        .withColumn("rate", F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct(F.col("cap_gone"), F.col("rate")))).over(everything)["rate"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("rate") * F.col("w")))
    )
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.lit(SHARE) * F.col("total").cast("double")
    return each.select(
        "source", "source_size", "target", "total",
        F.greatest(F.lit(BLOCK).cast("long"), F.ceil(F.col("total") / SLOTS)).alias("block"),
        F.coalesce(F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, -1)) / F.nullif(share, F.lit(0.0)), F.lit(0.0)).alias("lo"),
        F.coalesce(F.sum("target").over(running) / F.nullif(share, F.lit(0.0)), F.lit(0.0)).alias("hi"),
        (F.max("place").over(everything) == F.col("place")).alias("last"), "place",
    )


def schedule(of: DataFrame) -> DataFrame:
    """(slot, source, rank): which source's next block each slot takes.  ``of``: targets()."""
    spark = of.sparkSession
    # One row of totals fixes the number of slots.
    one = of.agg(F.max("total").alias("total"), F.max("block").alias("block")).first()
    total = one["total"] or 0
    slots = -(-int(SHARE * 2 * total) // (2 * one["block"])) if total else 0
    point = (F.col("slot").cast("double") + F.lit(0.5)) * F.lit(PHI)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    hi = F.when(F.col("last"), F.lit(1.0)).otherwise(F.col("hi"))
    parts = (
        of.where("target > 0 or last")
        .select("source", "place", "lo", hi.alias("hi"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)).cast("int"))))
    )
    met = points.join(parts, "cell").where("u >= lo and u < hi").select("slot", "source", "place", F.expr(f"slot div {SEGMENT}").alias("segment"))
    counts = met.groupBy("place", "segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("place").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("place", "segment").orderBy("slot"))
    return met.join(counts, ["place", "segment"]).select("slot", "source", (F.col("before") + own - 1).alias("rank"))


def _slices(sized: DataFrame, of: DataFrame) -> DataFrame:
    """(source, slice, words, offset) and the columns of ``of``: where each slice of a source's
    shuffled stream begins."""
    sums = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("source", "slice", "words", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")).join(of, "source")


def _placed(sized: DataFrame, slices: DataFrame) -> DataFrame:
    """Adds each document's first position in its source's shuffled stream of words, and its
    slice's columns.  Documents cross the network once, to the window of their slice; the short
    table that joins them there has that partitioning too."""
    inside = Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(slices, ["source", "slice"])
    return placed.withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): what the mix takes of every document."""
    sized = saved(_sized(docs, []), "mix-sized")
    of = targets(sized)
    placed = _placed(sized, _slices(sized, of.select("source", "source_size", "target", "block"))).select("doc_id", "source", "size", "source_size", "target", "start", "block")
    slots = schedule(of).select("source", "rank", F.lit(True).alias("read"))
    read = placed.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(REPEAT - 1)))).withColumn("from", F.col("start") + F.col("at") * F.col("source_size"))
    parts = read.withColumn("rank", F.explode(F.when(F.col("size") > 0, F.sequence(F.expr("`from` div block"), F.expr("(`from` + size - 1) div block"))).otherwise(F.array(F.lit(-1).cast("long")))))
    overlap = F.least(F.col("from") + F.col("size"), (F.col("rank") + 1) * F.col("block")) - F.greatest(F.col("from"), F.col("rank") * F.col("block"))
    met = parts.withColumn("words", overlap).join(slots, ["source", "rank"], "left")
    # Documents with words have a start of their own in their source; those without give a row each already.
    words = met.where("size > 0").groupBy("doc_id", "source", "start", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("read"), F.col("words")).otherwise(0)).alias("taken")
    )
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return words.select(*columns).unionAll(empty.select(*columns))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, in the order of the schedule: one row for
    each reading of the source's stream in which the document's first word lies in a block taken,
    or before the target where that is below FEW blocks, so whole texts only."""
    names = docs.columns
    plain = docs.select("doc_id", "source", "text", *(F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(names)))
    carried = [f"p_{i}" for i in range(len(names))]
    sized = saved(_sized(docs, []), "mix-sized")
    of = targets(sized)
    slots = saved(schedule(of), "mix-slots")
    length = slots.count()
    slices = _slices(sized, of.select("source", "source_size", "target", "block")).where("words > 0")
    # The slots that read each slice, reading by reading, in the order of its blocks.
    span = F.sequence(F.expr("(offset + at * source_size) div block"), F.expr("(offset + words - 1 + at * source_size) div block"))
    blocks = slices.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(REPEAT - 1)))).withColumn("rank", F.explode(span))
    blocks = blocks.join(slots, ["source", "rank"], "left").groupBy("source", "slice").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("at") == at, F.struct("rank", "slot")))).alias(f"slots_{at}") for at in range(REPEAT))
    )
    placed = _placed(_sized(plain, carried), slices.join(blocks, ["source", "slice"]))
    readings = []
    for at in range(REPEAT):
        start = F.col("start") + at * F.col("source_size")
        own = F.get(F.col(f"slots_{at}"), (F.expr(f"(start + {at} * source_size) div block - slots_{at}[0].rank")).cast("int"))["slot"]
        even = F.floor(start.cast("double") / F.col("target") * length).cast("long")
        slot = F.when(F.col("target") < FEW * F.col("block"), F.when(start < F.col("target"), F.least(even, F.lit(length - 1)))).otherwise(own)
        readings.append(F.struct(slot.alias("slot"), start.alias("from")))
    chosen = placed.where("size > 0").select(*carried, F.explode(F.array(*readings)).alias("reading")).where("reading.slot is not null")
    # A task's slots follow on those of the task before it.
    parts = partitions(docs.sparkSession)
    place = F.least(F.floor(F.col("reading.slot") * parts / max(length, 1)), F.lit(parts - 1)).cast("int")
    ordered = chosen.repartitionById(parts, place).sortWithinPartitions("reading.slot", "reading.from")
    return ordered.select(*(F.col(f"p_{i}").alias(c) for i, c in enumerate(names)))


_COUNT = f"len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}'))"
#: The same mix in DuckDB, with plain windows.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, {_COUNT}::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS key FROM documents),
each AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS w, source_size * {REPEAT} AS cap, sum(source_size) OVER ()::BIGINT AS total FROM each),
levels AS (
  SELECT *, sum(w) OVER (ORDER BY cap * (10 // w), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    coalesce(sum(cap) OVER (ORDER BY cap * (10 // w), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_gone FROM weighed),
rates AS (SELECT *, ({SHARE}::DOUBLE * total::DOUBLE - cap_gone::DOUBLE) / w_left::DOUBLE AS r FROM levels),
rate AS (SELECT arg_min(r, cap_gone) AS rate FROM rates WHERE r * w <= cap),
target AS (
  SELECT source, place, source_size, total, least(cap::DOUBLE, rate * w) AS target,
    greatest({BLOCK}, ceil(total / {SLOTS}))::BIGINT AS block FROM rates, rate),
parts AS (
  SELECT *, coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / ({SHARE}::DOUBLE * total) AS lo,
    CASE WHEN place = max(place) OVER () THEN 1.0::DOUBLE ELSE sum(target) OVER (ORDER BY place) / ({SHARE}::DOUBLE * total) END AS hi FROM target),
points AS (
  SELECT u - floor(u) AS u FROM (
    SELECT (i + 0.5::DOUBLE) * {PHI}::DOUBLE AS u
    FROM (SELECT unnest(range(coalesce((SELECT ceil({SHARE}::DOUBLE * max(total) / max(block))::BIGINT FROM target), 0))) AS i))),
slots AS (
  SELECT place, count(*) AS n FROM points JOIN parts ON u >= lo AND u < hi GROUP BY place),
placed AS (
  SELECT s.*, p.source_size, p.target, coalesce(n, 0) * block AS upto,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN slots t ON p.place = t.place)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, upto) - start) + greatest(0, least(start + source_size + size, upto) - start - source_size))::BIGINT AS taken
FROM placed"""
