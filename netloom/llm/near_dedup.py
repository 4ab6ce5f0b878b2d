"""Near-duplicate groups: banded MinHash candidates, odd sketches, exact confirmation.

A document is its set of distinct 5-word shingles.  Documents with equal sets are one node.
Nodes that agree on all MinHash values of a band share a bucket (BANDS x ROWS; a pair at a
threshold of 0.85 is missed by all bands with a probability below 1e-6, one at 0.8 below 1e-4).  Within buckets, pairs are
judged by odd sketches: one-permutation MinHash samples folded into a parity bitmap, where the
population count of the XOR gives the number of samples that differ, and so a high similarity,
to a fraction of a percent.  What may reach the threshold, five standard errors granted, is
confirmed on the full sets.

Components need few links, so pairs come in two rounds.  First every node meets the smallest
node of each of its buckets, a number of pairs linear in the buckets' rows.  Then only buckets
whose nodes still lie in several components are looked into, and only pairs across components
whose sketches allow a link leave the task.  Their nodes fall into classes by the logarithm of
their size, as wide as the threshold, so links lie within a class or between neighbouring ones and
no others meet; a class beyond CHUNK nodes is dealt out as pairs of chunks, so no task holds more
than two chunks.

Equality of shingles, and of sets, is that of 64-bit and 128-bit hashes (xxh3), so "confirmed on
the full sets" means on the full sets of hashes.

Defined results: null and empty texts, and texts of white space, have no shingles and link with
nothing; fewer than five words are one shingle; null ids are ignored as labels, and a group of
nothing but null ids has a null component; rows that repeat an id and a text are equal; other
columns are ignored; texts of any length are read whole; an empty table gives no rows.  ``kept``
decides by row: of a group one row stays, one with the group's smallest id; where several rows
have that id, the one whose text has the smallest hash, and of rows alike in both the smallest by
the other columns.  Rows without shingles all stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import WORD, grouped, marked, partitions, remove, saved, texts

SHINGLE = 5
#: Links need 100 * intersection >= percent * union; this is op4's.
PERCENT = 85
BANDS, ROWS = 32, 6
#: Bins of the one-permutation samples, bits of the odd sketch.
BINS_LOG, BITS_LOG = 12, 12
BITS = 1 << BITS_LOG
ERRORS = 5.0
CHUNK = 2048

_random = np.random.Generator(np.random.PCG64(20250101))
_MULTIPLY = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_PLACE = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64, seeded)."""
    x = (x + np.uint64(by * 0x9E3779B97F4A7C15 % (1 << 64))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, known: Words) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _PLACE[i]
    return np.unique(_mix(total, 1))


def digest(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def bands(items: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: its ROWS MinHash values and its number."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[None, i : i + 1024] * _MULTIPLY + _ADD).min(1), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i], i + 2)
    return key.view(np.int64)


def sketch(items: np.ndarray) -> tuple[int, bytes]:
    """(samples, parity bitmap): the smallest value of each bin that has any, folded."""
    y = np.sort(_mix(items, 99))
    bins = y >> np.uint64(64 - BINS_LOG)
    samples = y[np.r_[True, bins[1:] != bins[:-1]]] if len(y) else y
    at = (_mix(samples, 100) >> np.uint64(64 - BITS_LOG)).astype(np.int64)
    return len(samples), np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def possible(z: np.ndarray, s_a: np.ndarray, s_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes and samples, whose sketches differ in ``z`` bits, may reach the
    threshold: their sizes allow it and the estimate lies within ERRORS standard errors."""
    level = percent / 100
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * z / BITS, 1e-3))
    same = np.maximum((s_a + s_b - differ) / 2, 0)
    # A bin without a match counts twice in ``differ`` if both sets have a sample in it.
    both = 1 - np.exp(-np.minimum(n_a, n_b) / (1 << BINS_LOG))
    union = same + differ / (1 + both)
    estimate = same / np.maximum(union, 1e-9)
    taken = np.minimum(union * (1 + level) / (n_a + n_b), 1)
    load = 4 * differ / BITS
    folded = np.exp(load / 2) * np.sqrt(BITS / 4 * np.maximum(1 - np.exp(-load) * (1 + load), 0)) / ((1 + both) * np.maximum(union, 1))
    error = np.sqrt(level * (1 - level) / np.maximum(union, 1) * (1 - taken) + folded**2)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (estimate + ERRORS * error + 1e-9 >= level)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


SIGNED = "doc_id long, row_hash long, n_shingles long, digest binary, s int, sketch binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("s", pa.int32()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
    known = Words()

    def rows() -> Iterator[dict]:
        for batch in batches:
            for doc_id, row_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
                items = shingles(text, known)
                row = {"doc_id": doc_id, "row_hash": row_hash, "n_shingles": len(items)}
                if len(items):
                    s, bits = sketch(items)
                    row |= {"digest": digest(items), "s": s, "sketch": bits, "bands": bands(items)}
                yield row

    yield from grouped(rows(), schema, 512)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()

    def rows() -> Iterator[dict]:
        for batch in batches:
            for text in texts(batch):
                items = shingles(text, known)
                if len(items):
                    yield {"s_digest": digest(items), "items": items.tobytes()}

    yield from grouped(rows(), pa.schema([("s_digest", pa.binary()), ("items", pa.binary())]), 256)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _judge(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with both nodes' sketches: those that may link."""
    for batch in batches:
        number = lambda name: batch.column(name).to_numpy()  # noqa: E731, B023
        z = np.bitwise_count(_bits(batch.column("sketch_a")) ^ _bits(batch.column("sketch_b"))).sum(1, dtype=np.int64)
        good = possible(z, number("s_a"), number("s_b"), number("n_a"), number("n_b"), percent)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and pair of chunks (``cell``), of the left (``side`` 0) or the right chunk,
    or of one that meets itself (no right): pairs of different components that may link, each in the
    first band that its nodes share."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[pa.RecordBatch] = []
    last = None

    def pairs() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        number = lambda name: t.column(name).to_numpy()
        ids, comp, s, n, side, band = (number(k) for k in ("id", "comp", "s", "n", "side", "band"))
        bits = _bits(t.column("sketch").combine_chunks())
        keys = np.frombuffer(t.column("bands").combine_chunks().flatten().to_numpy(), np.int64).reshape(-1, BANDS)
        itself = t.column("itself")[0].as_py()
        right = np.flatnonzero(side == (0 if itself else 1))
        for i in np.flatnonzero(side == 0).tolist():
            j = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (not itself))]
            if not len(j):
                continue
            z = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            j = j[possible(z, np.full(len(j), s[i]), s[j], np.full(len(j), n[i]), n[j], percent)]
            j = j[(keys[j] == keys[i]).argmax(1) == band[i]] if len(j) else j
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], schema=schema)

    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in ("key", "cell")], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if start == end:
                continue
            first = tuple(key[start])
            if first != last and held:
                yield from pairs()
                held.clear()
            last = first
            held.append(batch.slice(start, end - start))
    if held:
        yield from pairs()


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link.  Only the texts of nodes in a pair are read again:
    a bit filter of fixed size keeps the others out before any shuffle."""
    spark = docs.sparkSession
    pairs = saved(pairs, "near-pairs")
    needed = pairs.select(F.col("a").alias("x")).union(pairs.select("b")).distinct()
    needed = saved(needed.join(nodes.select("id", "rep", "digest"), F.col("x") == F.col("id")).select("id", "rep", "digest"), "near-needed")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = marked(cut, F.xxhash64("doc_id"), needed, F.xxhash64("rep")).where("maybe")
    sets = cut.select("doc_id", "text").mapInArrow(_sets, "s_digest binary, items binary")
    sets = sets.join(needed.select("id", "digest"), F.col("s_digest") == F.col("digest")).groupBy("id").agg(F.first("items").alias("items"))
    sets = saved(sets, "near-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    return saved(both.mapInArrow(partial(_confirm, percent=percent), "a long, b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every node in a link: the smallest id it reaches.

    Each round gives every node its smallest neighbour, contracts the graph to these and drops
    links within.  One round dissolves stars.  From the second on a node follows these steps to
    their end, by doubling, before the graph is contracted: then at most every other node is left,
    and a chain of any order takes a logarithmic number of joins.  The rounds' maps are then
    followed from the last to the first.  Tables in the shared folder cut the lineage.
    """
    edges, maps = saved(links.select("a", "b").distinct(), "near-edges"), []
    while not maps or not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        step = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "near-map")
        further = bool(maps)
        while further:
            on = step.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
            step = saved(step.join(on, "comp").select("id", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), "near-map")
            further = not step.where("moved").isEmpty()
            step = step.drop("moved")
        maps.append(step)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(step.select(F.col("id").alias(end), F.col("comp").alias(f"to_{end}")), end)
        shrunk = ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = saved(shrunk.distinct(), "near-edges")
    out = maps.pop()
    while maps:
        up = out.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        out = maps.pop().join(up, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    return saved(out, "near-components")


def _between(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links as links between the components of their ends; a node in none stands for itself."""
    out = links.select("a", "b")
    for end in ("a", "b"):
        out = out.join(comp.select(F.col("id").alias(end), F.col("comp").alias(f"c_{end}")), end, "left")
    out = out.select(F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _row_hash() -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row_hash, n_shingles, comp, component_id) of every document: the number of its
    group, null without shingles, and the group's smallest id."""
    spark = docs.sparkSession
    parts = max(partitions(spark), 12)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("row_hash"), F.col("text").cast("string").alias("text"))
    signed = saved(cut.mapInArrow(_sign, SIGNED), "near-signed")
    # One node for each set; its number is fixed by writing it.
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "s", "sketch", "bands")]
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), *firsts)
    nodes = saved(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    listed = saved(signed.select("doc_id", "row_hash", "n_shingles", "digest"), "near-listed")
    for path in {f.rpartition("/")[0] for f in signed.inputFiles()}:
        remove(spark, path)

    # Sets that link differ in size by at most the threshold, so by one class.
    width = math.log(100 / percent) * (1 + 1e-9)
    cls = F.floor(F.ln(F.col("n_shingles").cast("double")) / F.lit(width)).cast("int")
    rows = nodes.select("id", cls.alias("cls"), F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = saved(rows.join(buckets, "key"), "near-buckets")

    features = lambda end: nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"{k}_{end}") for c, k in (("s", "s"), ("n_shingles", "n"), ("sketch", "sketch"))))
    stars = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    judged = stars.join(features("a"), "a").join(features("b"), "b").mapInArrow(partial(_judge, percent=percent), "a long, b long")
    links = _confirmed(judged, nodes, docs, percent)
    comp = components(links)

    # Buckets that still hold several components: the chunks of their classes, and of the next ones.
    held = shared.join(comp, "id", "left").select("key", "cls", "band", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = held.groupBy("key", "cls").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("key", "cls", "least", "most", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    beside = lambda step, name: sizes.select("key", (F.col("cls") - step).alias("cls"), *(F.col(c).alias(f"{c}_{name}") for c in ("least", "most", "chunks")))
    open_ = sizes.join(beside(1, "up"), ["key", "cls"], "left").join(beside(-1, "down"), ["key", "cls"], "left")
    several = lambda name: F.least("least", f"least_{name}") < F.greatest("most", f"most_{name}")
    # How many chunks of its own class, the next and the one before a node meets: 0 where all lie in one component.
    open_ = open_.select(
        "key", "cls", "chunks", F.when(F.col("least") < F.col("most"), F.col("chunks")).otherwise(0).alias("own"),
        *(F.when(several(name) & F.col(f"chunks_{name}").isNotNull(), F.col(f"chunks_{name}")).otherwise(0).alias(name) for name in ("up", "down")),
    ).where("own + up + down > 0")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = held.join(open_, ["key", "cls"]).withColumn("chunk", chunk)
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda low, up, lo, hi: F.xxhash64(low, up, lo, hi)
    met = lambda c, side, itself: F.struct(c.alias("cell"), side.cast("int").alias("side"), itself.alias("itself"))
    within = F.transform(upto("own"), lambda o: met(cell(F.col("cls"), F.col("cls"), F.least("chunk", o), F.greatest("chunk", o)), F.col("chunk") > o, F.col("chunk") == o))
    above = F.transform(upto("up"), lambda o: met(cell(F.col("cls"), F.col("cls") + 1, F.col("chunk"), o), F.lit(False), F.lit(False)))
    below = F.transform(upto("down"), lambda o: met(cell(F.col("cls") - 1, F.col("cls"), o, F.col("chunk")), F.lit(True), F.lit(False)))
    dealt = dealt.select("key", "band", "id", "comp", F.explode(F.concat(within, above, below)).alias("met")).select("key", "band", "id", "comp", "met.*")
    dealt = dealt.join(nodes.select("id", "s", F.col("n_shingles").alias("n"), "sketch", "bands"), "id").repartition(parts, "key", "cell")
    across = dealt.sortWithinPartitions("key", "cell").mapInArrow(partial(_across, percent=percent), "a long, b long")
    more = _confirmed(across, nodes, docs, percent)
    # Links between components, then each node's component in the final graph.
    top = components(_between(more, comp))
    comp = comp.join(top.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "full")
    comp = comp.select(F.coalesce("id", "comp").alias("id"), F.coalesce("top", "comp").alias("comp"))

    label = nodes.select("id", "rep", "digest").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "comp").select(F.col("digest").alias("l_digest"), "comp", "component_id")
    out = listed.join(label, F.col("digest") == F.col("l_digest"), "left")
    return out.select("doc_id", "row_hash", "n_shingles", "comp", "component_id")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; links are at ``percent``."""
    # A document without shingles is a group of its own.
    component = F.when(F.col("comp").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = _labelled(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one row for each group, with all their columns.  Only rows that
    may be dropped are dealt out by id; the others never leave their tasks."""
    rows = _labelled(docs, percent).where("comp is not null").groupBy("comp", "component_id", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    # Rows with the smallest id: one row of each group, but for ids that repeat.
    rows = saved(rows.withColumn("first", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-rows")
    more = rows.where("first").groupBy(F.col("comp").alias("m_comp")).agg(F.min("row_hash").alias("least"), F.count(F.lit(1)).alias("firsts")).where("firsts > 1")
    rows = rows.join(more, F.col("comp") == F.col("m_comp"), "left")
    stays = F.col("first") & (F.col("least").isNull() | (F.col("row_hash") == F.col("least")))
    verdict = rows.select(F.col("doc_id").alias("v_id"), F.col("row_hash").alias("v_hash"), stays.alias("stays"), "n").where("not stays or n > 1")
    verdict = saved(verdict, "near-verdict")
    names = docs.columns
    plain = docs.select(F.col("doc_id").cast("long").alias("key"), _row_hash().alias("row_hash"), *(F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(names)))
    told = marked(plain, F.xxhash64("key", "row_hash"), verdict, F.xxhash64("v_id", "v_hash"))
    met = told.where("maybe").join(verdict, F.col("key").eqNullSafe(F.col("v_id")) & (F.col("row_hash") == F.col("v_hash")), "left")
    columns = [f"p_{i}" for i in range(len(names))]
    # Rows alike in id and text: the smallest by all columns.
    one = met.where("stays").groupBy("key", "row_hash").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    out = told.where("not maybe").select(*columns).unionAll(met.where("stays is null").select(*columns)).unionAll(one)
    return out.select(*(F.col(f"p_{i}").alias(c) for i, c in enumerate(names)))
