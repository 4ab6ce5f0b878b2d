"""Mixing matrices and assortativity, observed and under random labels, for whole cohorts.

An edge joins both ends' label sets once; all pairs of attributes are counted in that pass, each
edge once per pair however many ways it matches.  Matrices are long: (keys, i, j, value).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import ranks
from netloom.functions.ranks import hash_key, ranked
from netloom.model import KEYS, label_sets
from netloom.operators.blocked import written

SHUFFLES = 50
#: Edges of a network whose permutations are counted in one task, and edge ends that it holds at a time.
LINKS, HELD = 1 << 20, 1 << 22


def _ends(labels: DataFrame, edges: DataFrame, keys: Sequence[str], wide: bool = False) -> DataFrame:
    """(keys, src, dst): both ends' label columns of each edge.  ``wide`` labels hold arrays whose
    length no estimate knows, so they are never broadcast."""
    rest = [c for c in labels.columns if c not in (*keys, "node_id")]
    labels = labels.hint("merge") if wide else labels
    end = lambda name, out: labels.select(*keys, F.col("node_id").alias(name), F.struct(*rest).alias(out))
    return edges.select(*keys, "source", "target").join(end("source", "src"), [*keys, "source"]).join(end("target", "dst"), [*keys, "target"])


def _pairs(src: Column, dst: Column, directed: bool = False) -> Column:
    """The attribute pairs of an edge, each once."""
    one = lambda i, j: F.struct(i.alias("i"), j.alias("j")) if directed else F.struct(F.greatest(i, j).alias("i"), F.least(i, j).alias("j"))
    return F.array_distinct(F.flatten(F.transform(src, lambda i: F.transform(dst, lambda j: one(i, j)))))


def pair_counts(labels: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, directed: bool = False) -> DataFrame:
    """(keys, i, j, n): edges for each pair of attributes that has any; i >= j unless directed.
    A self-loop or a pair that matches both ways counts once, repeated edges each count."""
    pairs = _ends(labels, edges, keys).select(*keys, F.explode(_pairs(F.col("src.labels"), F.col("dst.labels"), directed)).alias("p"))
    return pairs.groupBy(*keys, "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"))


def count_edges(labels: DataFrame, edges: DataFrame, a: int, b: int, keys: Sequence[str] = KEYS, directed: bool = False) -> DataFrame:
    """(keys, n): edges from an a to a b; either way round unless directed; 0 where none."""
    has = lambda end, x: F.array_contains(F.col(f"{end}.labels"), x)
    match = has("src", a) & has("dst", b)
    match = match if directed else match | (has("dst", a) & has("src", b))
    return _ends(labels, edges, keys).groupBy(*keys).agg(F.count_if(match).alias("n"))


def _dense(counts: DataFrame, samples: DataFrame, size: int, keys: Sequence[str], both: bool, diagonal: int, deal: Sequence[str]) -> DataFrame:
    """(keys, i, j, n, total): adds the pairs without edges as 0; ``both``: the whole matrix instead of
    i >= j.  ``total`` is the sum of the whole matrix with ``diagonal`` times its inner edges.

    A sample's counts fit a map of at most size (size + 1) / 2 entries.  Rows of equal ``deal`` stay
    together, so sums over them need no further shuffle.
    """
    entry = F.when(F.col("n").isNotNull(), F.struct((F.col("i") * size + F.col("j")).alias("p"), F.col("n").alias("n")))
    every = samples.withColumns({c: F.lit(None).cast(counts.schema[c].dataType) for c in ("i", "j", "n")}).unionByName(counts)
    weight = F.when(F.col("i") == F.col("j"), F.lit(diagonal)).otherwise(2)
    maps = every.repartition(*deal).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.sum(F.col("n") * weight).cast("double").alias("total"))
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(size if both else i + 1)))
    cells = maps.select(*keys, "m", "total", F.explode(grid).alias("g")).select(*keys, "m", "total", "g.i", "g.j")
    place = F.greatest("i", "j") * size + F.least("i", "j")
    return cells.select(*keys, "i", "j", F.coalesce(F.try_element_at("m", place), F.lit(0)).cast("long").alias("n"), "total")


def mixing_matrix(labels: DataFrame, edges: DataFrame, size: int, keys: Sequence[str] = KEYS, normalized: bool = True, double_diag: bool = True) -> DataFrame:
    """(keys, i, j, value): the whole symmetric matrix of every network that has nodes; with
    ``double_diag`` an inner edge counts at both ends.  Without edges normalised values are null."""
    diagonal = 2 if double_diag else 1
    dense = _dense(pair_counts(labels, edges, keys), labels.select(*keys).distinct(), size, keys, True, diagonal, keys)
    value = (F.col("n") * F.when(F.col("i") == F.col("j"), diagonal).otherwise(1)).cast("double")
    return dense.select(*keys, "i", "j", (value / F.nullif("total", F.lit(0.0)) if normalized else value).alias("value"))


def assortativity(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, assort): (trace - sum M^2) / (1 - sum M^2) of the matrix scaled to sum 1; null where
    all edges lie in one class or there are none."""
    rows = matrix.groupBy(*keys, "i").agg(F.sum("value").alias("a"), F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(0.0)).alias("d"))
    sums = rows.groupBy(*keys).agg(F.sum("a").alias("t"), F.sum("d").alias("tr"), F.sum(F.col("a") * F.col("a")).alias("s"))
    t, tr, s = F.col("t"), F.col("tr"), F.col("s")
    return sums.select(*keys, ((t * tr - s) / F.nullif(t * t - s, F.lit(0.0))).alias("assort"))


def _places(ids: list[bytes], prefix: str) -> np.ndarray:
    """The order of ids by md5 of prefix and id."""
    start, digests = hashlib.md5(f"{prefix}:".encode()), []
    for i in ids:
        own = start.copy()
        own.update(i)
        digests.append(own.digest())
    digests = b"".join(digests)
    high, low = np.frombuffer(digests, ">u8").reshape(-1, 2).T
    return np.lexsort((low, high))


def _randomized_whole(labels: DataFrame, n_shuffle: int, keys: Sequence[str]) -> DataFrame:
    """Networks of at most LARGE nodes, all permutations of one in a task."""
    own = labels.select(*keys, "node_id", "labels", F.encode(F.col("node_id").cast("string"), "UTF-8").alias("_id"))
    shuffled = T.StructField("shuffled", T.ArrayType(labels.schema["labels"].dataType))

    def one(rows: pa.Table) -> pa.Table:
        ids, sets = rows["_id"].to_pylist(), rows["labels"].combine_chunks()
        base, at = _places(ids, "base"), np.empty((len(ids), n_shuffle), np.int64)
        for k in range(n_shuffle):
            at[_places(ids, str(k)), k] = base
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(n_shuffle))
        return rows.select([*keys, "node_id"]).append_column("shuffled", pa.ListArray.from_arrays(ends, sets.take(pa.array(at.ravel()))))

    return own.groupBy(*keys).applyInArrow(one, T.StructType([*own.select(*keys, "node_id").schema.fields, shuffled]))


def _randomized_sliced(labels: DataFrame, n_shuffle: int, keys: Sequence[str]) -> DataFrame:
    """Networks of any size, ranked by slices of the hash."""
    base = ranked(labels.withColumn("_key", hash_key(F.lit("base"), F.col("node_id"))), keys, "_key", "node_id", "_place", "_size").select(*keys, "_place", "labels")
    every = labels.select(*keys, "node_id", "_size", F.explode(F.sequence(F.lit(0), F.lit(n_shuffle - 1))).alias("k"))
    every = ranked(every.withColumn("_key", hash_key(F.col("k"), F.col("node_id"))), [*keys, "k"], "_key", "node_id", "_place", "_size")
    moved = every.join(base, [*keys, "_place"]).groupBy(*keys, "node_id")
    return moved.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "labels"))), lambda x: x["labels"]).alias("shuffled"))


def randomized(labels: DataFrame, n_shuffle: int = SHUFFLES, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node_id, shuffled): each node's label sets under ``n_shuffle`` permutations of the
    network's nodes; labels of one node stay together.  Permutation k orders ids by md5 of k and id,
    so any partitioning and any engine gives the same.  A small network's permutations are made in one
    task, those of large networks by slices; a first count tells whether there are any."""
    sizes = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.where(F.col("_size") > ranks.LARGE)
    if large.isEmpty():
        return _randomized_whole(labels, n_shuffle, keys)
    small = _randomized_whole(labels.join(large.select(*keys), [*keys], "left_anti"), n_shuffle, keys)
    return small.unionByName(_randomized_sliced(labels.join(large, [*keys]), n_shuffle, keys))


def _split(kinds: list[tuple], met: np.ndarray, n: np.ndarray, n_shuffle: int) -> tuple[np.ndarray, ...]:
    """(k, i, j, n) of label pairs from counts ``n`` of (k, label set, label set), coded in ``met``."""
    c = len(kinds)
    own, at = np.unique(met % (c * c), return_inverse=True)
    pairs = [sorted({(max(i, j), min(i, j)) for i in kinds[m // c] for j in kinds[m % c]}) for m in own.tolist()]
    lengths = np.array([len(p) for p in pairs], np.int64)
    flat = np.array([e for p in pairs for e in p], np.int64).reshape(-1, 2)
    times, start = lengths[at], np.r_[0, np.cumsum(lengths)][at]
    row = np.repeat(np.arange(len(met)), times)
    e = flat[np.repeat(start, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
    size = int(flat.max(initial=0)) + 1
    found, inverse = np.unique(((met // (c * c))[row] * size + e[:, 0]) * size + e[:, 1], return_inverse=True)
    return found // (size * size), found // size % size, found % size, np.bincount(inverse, n[row], len(found)).astype(np.int64)


def _counted_whole(labels: DataFrame, edges: DataFrame, n_shuffle: int, keys: Sequence[str]) -> DataFrame:
    """(keys, k, i, j, n) of networks of at most LARGE nodes and LINKS edges: a network's nodes and edges
    meet in one task, which permutes the labels and counts; only counts leave it."""
    label = labels.schema["labels"].dataType.elementType
    own = labels.select(*keys, "node_id", "labels", F.encode(F.col("node_id").cast("string"), "UTF-8").alias("_id"))
    links = edges.select(*keys, *(F.col(c).cast(own.schema["node_id"].dataType).alias(c) for c in ("source", "target")))
    schema = T.StructType([*own.select(*keys).schema.fields, T.StructField("k", T.IntegerType()), T.StructField("i", label), T.StructField("j", label), T.StructField("n", T.LongType())])

    def one(key: tuple, nodes: pa.Table, links: pa.Table) -> pa.Table:
        ids = nodes["node_id"].combine_chunks()
        s, t = (pc.index_in(links[c].combine_chunks(), value_set=ids, skip_nulls=True) for c in ("source", "target"))
        both = pc.and_(s.is_valid(), t.is_valid())
        s, t = (v.filter(both).to_numpy(zero_copy_only=False).astype(np.int64) for v in (s, t))
        kinds: dict[tuple, int] = {}
        own = np.array([kinds.setdefault(tuple(v or ()), len(kinds)) for v in nodes["labels"].to_pylist()], np.int64)
        names, c = nodes["_id"].to_pylist(), len(kinds)
        found, step = [], max(1, HELD // max(1, len(s)))
        base = own[_places(names, "base")] if len(s) else own
        for first in range(0, n_shuffle if len(s) else 0, step):
            ks = range(first, min(first + step, n_shuffle))
            at = np.empty((len(ks), len(names)), np.int64)
            for r, k in enumerate(ks):
                at[r, _places(names, str(k))] = base
            a, b = at[:, s], at[:, t]
            met, n = np.unique((np.arange(len(ks))[:, None] * c + np.maximum(a, b)) * c + np.minimum(a, b), return_counts=True)
            found.append(_split(list(kinds), met + first * c * c, n, n_shuffle))
        k, i, j, n = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        cells = [pa.array([v.as_py()] * len(k), v.type) for v in key]
        return pa.table([*cells, pa.array(k.astype(np.int32)), pa.array(i, pa.int64()).cast(_arrow(label)), pa.array(j, pa.int64()).cast(_arrow(label)), pa.array(n)], names=schema.names)

    return own.groupBy(*keys).cogroup(links.groupBy(*keys)).applyInArrow(one, schema)


def _arrow(label: T.DataType) -> pa.DataType:
    return pa.int64() if isinstance(label, T.LongType) else pa.int32()


def _counted_sliced(labels: DataFrame, edges: DataFrame, n_shuffle: int, keys: Sequence[str]) -> DataFrame:
    """(keys, k, i, j, n) of networks of any size; edges are joined once for all permutations."""
    ends = _ends(randomized(labels, n_shuffle, keys), edges, keys, wide=True)
    each = ends.select(*keys, F.posexplode(F.arrays_zip(F.col("src.shuffled").alias("s"), F.col("dst.shuffled").alias("d"))).alias("k", "e"))
    pairs = each.select(*keys, "k", F.explode(_pairs(F.col("e.s"), F.col("e.d"))).alias("p"))
    return pairs.groupBy(*keys, "k", "p.i", "p.j").agg(F.count(F.lit(1)).alias("n"))


def randomized_counts(labels: DataFrame, edges: DataFrame, n_shuffle: int = SHUFFLES, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, k, i, j, n) of every permutation.  A network of few nodes and edges is counted where it is
    permuted; only large ones carry their permutations through joins."""
    sizes = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    links = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_links"))
    large = sizes.where(F.col("_size") > ranks.LARGE).select(*keys).union(links.where(F.col("_links") > LINKS).select(*keys)).distinct()
    if large.isEmpty():
        return _counted_whole(labels, edges, n_shuffle, keys)
    few, many = ([t.join(large, [*keys], how) for t in (labels, edges)] for how in ("left_anti", "left_semi"))
    return _counted_whole(*few, n_shuffle, keys).unionByName(_counted_sliced(*many, n_shuffle, keys))


def randomized_matrices(labels: DataFrame, edges: DataFrame, size: int, n_shuffle: int = SHUFFLES, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, k, i, j, value): the normalised matrix of each permutation, absent pairs as 0."""
    samples = labels.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_shuffle - 1))))
    dense = _dense(randomized_counts(labels, edges, n_shuffle, keys), samples, size, [*keys, "k"], True, 2, keys)
    value = (F.col("n") * F.when(F.col("i") == F.col("j"), 2).otherwise(1)).cast("double")
    return dense.select(*keys, "k", "i", "j", (value / F.nullif("total", F.lit(0.0))).alias("value"))


def zscore(observed: DataFrame, random: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """(on, raw, mean, std, z): against the mean and population deviation over permutations; z is
    null where the deviation is 0."""
    null = random.groupBy(*on).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return observed.select(*on, F.col(value).alias("raw")).join(null, [*on], "left").withColumn("z", (F.col("raw") - F.col("mean")) / F.nullif("std", F.lit(0.0)))


def pair_name(attributes: Sequence[str], prefix: str = "", medfix: str = " - ", suffix: str = "") -> list[str]:
    """Names of the lower triangle, row by row."""
    return [f"{prefix}{attributes[i]}{medfix}{attributes[j]}{suffix}" for i in range(len(attributes)) for j in range(i + 1)]


def sample_stats(nodes: DataFrame, edges: DataFrame, attributes: Sequence[str], keys: Sequence[str] = KEYS, n_shuffle: int = SHUFFLES, labels: DataFrame | None = None) -> DataFrame:
    """One wide row per network: totals, proportions, and raw, MEAN, STD and Z of the assortativity
    and of every pair.  Both short tables of matrices are written once."""
    labels = label_sets(nodes, attributes, keys) if labels is None else labels
    size = len(attributes)
    share = [(F.count_if(F.array_contains("labels", i)) / F.count(F.lit(1))).alias(f"% {a}") for i, a in enumerate(attributes)]
    totals = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("# total"), *share)
    matrix = written(mixing_matrix(labels, edges, size, keys), "matrices")
    random = written(randomized_matrices(labels, edges, size, n_shuffle, keys), "random")
    mixed = zscore(matrix.where("i >= j"), random.where("i >= j"), [*keys, "i", "j"])
    whole = zscore(assortativity(matrix, keys), assortativity(random, [*keys, "k"]), keys, "assort")
    whole = whole.select(*keys, F.col("raw").alias("assort"), *(F.col(k).alias(f"assort {k.upper()}" if k != "z" else "assort Z") for k in ("mean", "std", "z")))
    cells = [(i, j) for i in range(size) for j in range(i + 1)]
    at = lambda i, j, c: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c)))
    wide = [at(i, j, c).alias(f"{attributes[i]} - {attributes[j]} {s}") for i, j in cells for c, s in (("raw", "RAW"), ("mean", "MEAN"), ("std", "STD"), ("z", "Z"))]
    return totals.join(whole, [*keys]).join(mixed.groupBy(*keys).agg(*wide), [*keys])


def to_wide(matrix: DataFrame, attributes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, attribute, one column per attribute) of a long matrix."""
    names = F.array(*map(F.lit, attributes))
    cells = [F.max(F.when(F.col("j") == j, F.col("value"))).alias(a) for j, a in enumerate(attributes)]
    return matrix.groupBy(*keys, "i").agg(*cells).select(*keys, F.get(names, "i").alias("attribute"), *(f"`{a}`" for a in attributes))


def to_columns(matrix: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, position, value): the lower triangle flattened row by row."""
    return matrix.where("i >= j").select(*keys, F.expr("cast(i * (i + 1) div 2 + j as int)").alias("position"), "value")


def from_named(series: DataFrame, keys: Sequence[str] = KEYS, medfix: str = " - ", discard: str = " Z") -> DataFrame:
    """(keys, a, b, value): a symmetric matrix from rows named ``a<medfix>b``."""
    part = lambda n: F.replace(F.split_part("name", F.lit(medfix), F.lit(n)), F.lit(discard), F.lit(""))
    half = series.select(*keys, part(1).alias("a"), part(2).alias("b"), "value")
    return half.union(half.where("a <> b").select(*keys, "b", "a", "value"))


def select_edges(ids: DataFrame, edges: DataFrame, how: str = "inner", keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with both ends (inner) or an end (outer) among ``ids`` (keys, node_id), each once."""
    some = ids.select(*keys, "node_id").distinct()
    at = lambda name: some.select(*keys, F.col("node_id").alias(name))
    if how == "inner":
        return edges.join(at("source"), [*keys, "source"], "left_semi").join(at("target"), [*keys, "target"], "left_semi")
    if how != "outer":
        raise ValueError("how must be 'inner' or 'outer'")
    hit = lambda name, out: at(name).withColumn(out, F.lit(True))
    both = edges.join(hit("source", "_s"), [*keys, "source"], "left").join(hit("target", "_t"), [*keys, "target"], "left")
    return both.where("_s or _t").select(*edges.columns)


def select_group(nodes: DataFrame, edges: DataFrame, group: str, value) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one network of a cohort that one column tells apart."""
    return nodes.where(F.col(group) == value), edges.where(F.col(group) == value)
