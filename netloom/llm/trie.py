"""The trie of conversations: what prefixes of turns they share.

Conversations become sequences of turn digests; equal sequences are one, with the digest of their
ids, made a packed range of ids at a time.  Sequences are dealt out by their first turn's digest,
and each first turn's subtrie is built of dictionaries of pointers in one task, then summed up
backwards.  A first turn with more than ``most`` turns below it isn't built whole: its subtrie is
dealt out anew by the next turn, and so on, and the few prefixes above the dealt subtries, the
root included, are summed up from what the subtries give.  How deep that goes is found with
windows of depths that double, so a long common start takes few rounds.

Defined results: null roles and texts are empty ones; turns with equal numbers are ordered by the
digest of role and text, repeated turns count as often as they occur; rows without a conv_id belong
to no conversation and are left out; other columns are ignored, whatever their names; an empty
table gives no nodes.  Turns are told apart by 128 bits of the SHA-256 of role and text.  Texts
never leave the first pass; a conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import partitions, saved

#: Bytes of a turn's digest.
WIDTH = 16
#: Turns below a prefix, at most, for its subtrie to be built in one piece.
MOST = 2048
#: Turns that a task's subtries have together, about.
TASK = 16384
#: Consecutive ids that are packed in a row.
RANGE = 4096
#: Rows that ask for the same parent are spread over so many keys.
SALTS = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<t string, b int>>): each conversation's turns in order, as
    digests in hex and bytes of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("t"), F.octet_length(text).alias("b"))
    every = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t", "b"))).alias("turns"))
    return every.select("conv_id", F.expr("transform(turns, x -> struct(x.t as t, x.b as b))").alias("turns"))


def rebuilt(own: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Conversations that share starts: the first h turns of the family's first conversation, then
    what is left of its own after its first h; h, up to ``most``, follows from the id."""
    heads = own.where(F.expr(f"conv_id % {family} = 0")).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, most).alias("_front"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    met = own.withColumn("_h", h.cast("int")).withColumn("_head", F.expr(f"conv_id - conv_id % {family}")).join(heads, "_head", "left")
    turns = F.expr("concat(slice(coalesce(_front, slice(turns, 1, 0)), 1, _h), slice(turns, _h + 1, greatest(size(turns) - _h, 0)))")
    return met.select("conv_id", turns.alias("turns"))


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and range of ids: how many ids each sequence has, the smallest, and
    the digest of all, whose text is never held whole."""
    schema = pa.schema([("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    at, sha, n, least = None, hashlib.sha256(), 0, 0
    for batch in batches:
        out = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    out.append({"n": n, "least": least, "ends": sha.hexdigest()})
                at, sha, n, least = key, hashlib.sha256(), 0, ids[0]
            sha.update(((b"," if n else b"") + ",".join(map(str, ids)).encode()))
            n += len(ids)
        yield pa.RecordBatch.from_pylist(out, schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"n": n, "least": least, "ends": sha.hexdigest()}], schema)


def sequences(conversations: DataFrame) -> DataFrame:
    """(least, n, ends, ts binary, bs array<int>): each distinct sequence of turns, the conversations
    that have it, its digests end to end and its texts' bytes."""
    whole = conversations.select("conv_id", F.unhex(F.array_join("turns.t", "")).alias("ts"), F.col("turns.b").alias("bs"))
    whole = saved(whole, "trie-whole")
    packed = whole.groupBy(F.sha2("ts", 256).alias("key"), F.floor(F.col("conv_id") / RANGE).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    rows = packed.repartition(max(partitions(whole.sparkSession), 12), "key").sortWithinPartitions("key", "part")
    ends = rows.mapInArrow(_ends, "n long, least long, ends string")
    return saved(ends.join(whole.withColumnRenamed("conv_id", "least"), "least"), "trie-sequences")


def _prefix(digests: str, depth: str) -> Column:
    return F.expr(f"substring({digests}, 1, {WIDTH} * {depth})")


def _depths(seqs: DataFrame, most: int) -> DataFrame | None:
    """(least, deepest): the longest prefix of a sequence below which there are two sequences or
    more and more than ``most`` turns; None where no sequence has one."""
    found, live, low, high = [], seqs, 0, 1
    while True:
        depths = F.explode(F.sequence(F.lit(low + 1), F.least(F.size("bs"), F.lit(high))))
        rows = live.where(F.size("bs") > low).select("least", F.size("bs").alias("turns"), "ts", depths.alias("depth")).withColumn("front", _prefix("ts", "depth")).drop("ts")
        large = rows.groupBy("front").agg(F.count("*").alias("seqs"), F.sum("turns").alias("turns")).where((F.col("seqs") > 1) & (F.col("turns") > most))
        large = saved(large.select("front"), "trie-large")
        if large.isEmpty():
            break
        hit = saved(rows.join(large, "front").groupBy("least").agg(F.max("depth").alias("deepest")), "trie-deep")
        found.append(hit)
        live = seqs.join(hit.where(F.col("deepest") == high), "least").select(*seqs.columns)
        low, high = high, 2 * high + 1
    if not found:
        return None
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("least").agg(F.max("deepest").alias("deepest"))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, front binary, sizes array<int>"


def _subtrie(rows: pd.DataFrame, deepest: int) -> Iterator[tuple]:
    """The nodes of one subtrie: its top is the prefix one turn longer than ``deepest``.  A child is
    numbered after its parent, so going backwards visits all of a node's children before it."""
    kids: list[dict[bytes, int]] = [{}]
    up, depth, size = [-1], [deepest + 1], [0]
    convs, least, ends = [0], [None], [NO_ENDS]
    for ts, bs, n, conv_id, own_ends in rows.itertuples(index=False):
        at, size[0] = 0, int(bs[deepest])
        for i in range(deepest, len(bs)):
            if i > deepest:
                key = ts[WIDTH * i : WIDTH * (i + 1)]
                to = kids[at].get(key)
                if to is None:
                    to = kids[at][key] = len(kids)
                    kids.append({})
                    up.append(at)
                    depth.append(i + 1)
                    size.append(int(bs[i]))
                    convs.append(0)
                    least.append(None)
                    ends.append(NO_ENDS)
                at = to
            convs[at] += n
            if least[at] is None or conv_id < least[at]:
                least[at] = conv_id
        ends[at] = own_ends
    leaves, spared = [0] * len(kids), [0] * len(kids)
    for at in range(len(kids) - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        spared[at] += (convs[at] - 1) * size[at]
        if at:
            leaves[up[at]] += leaves[at]
            spared[up[at]] += spared[at]
    front, sizes = bytes(rows["ts"].iloc[0][: WIDTH * deepest]), [int(b) for b in rows["bs"].iloc[0][:deepest]]
    for at in range(len(kids)):
        place = (least[up[at]], None, None) if at else (None, front, sizes)
        yield least[at], depth[at], place[0], convs[at], len(kids[at]), leaves[at], spared[at], ends[at], *place[1:]


def _subtries(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries that a task was dealt."""
    names = [c.split()[0] for c in NODES.split(", ")]
    frame = frame.assign(top=[bytes(ts[: WIDTH * (d + 1)]) for ts, d in zip(frame["ts"], frame["deepest"], strict=True)])
    rows = [node for (_, deepest), own in frame.groupby(["top", "deepest"], sort=False) for node in _subtrie(own[["ts", "bs", "n", "least", "ends"]], int(deepest))]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"parent_conv_id": "Int64"})


def nodes(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a
    row for each distinct prefix of the conversations (conv_id, turns), as ``ordered`` makes them."""
    spark = conversations.sparkSession
    seqs = sequences(conversations)
    deep = _depths(seqs, most)
    if deep is not None:
        seqs = seqs.join(deep, "least", "left").fillna(0, ["deepest"])
    else:
        seqs = seqs.withColumn("deepest", F.lit(0))
    turns = seqs.agg(F.sum(F.size("bs"))).first()[0] or 0
    deals = max(partitions(spark), -(-turns // TASK))
    dealt = seqs.where(F.size("bs") > F.col("deepest")).withColumn("deal", F.pmod(F.xxhash64(_prefix("ts", "(deepest + 1)")), F.lit(deals)))
    built = dealt.groupBy("deal").applyInPandas(lambda frame: _subtries(frame), NODES)
    built = saved(built, "trie-built")

    # What subtries, and conversations that end above all subtries, give to each prefix above them.
    tops = built.where("front is not null")
    enders = seqs.where(F.size("bs") == F.col("deepest"))
    gives = tops.select("front", "sizes", F.col("n_convs").alias("n"), F.col("conv_id").alias("least"), "n_leaves", "saved_tokens", F.lit(1).alias("child"))
    gives = gives.unionByName(enders.select(F.col("ts").alias("front"), F.col("bs").alias("sizes"), "n", "least", F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.lit(0).alias("child")))
    above = gives.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("sizes"))))
    last = F.col("depth") == F.size("sizes")
    above = above.select(_prefix("front", "depth").alias("front"), "depth", F.expr("if(depth = 0, 0, get(sizes, depth - 1))").alias("size"), "n", "least", "n_leaves", "saved_tokens", F.when(last, F.col("child")).otherwise(0).alias("child"))
    high = above.groupBy("front", "depth").agg(
        F.max("size").alias("size"), F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.sum("child").alias("child")
    )
    high = saved(high, "trie-high")
    up = _prefix("front", "(depth - 1)")
    own = high.where("depth > 0").select(F.explode(F.sequence(F.lit(0), "depth")).alias("d"), "front", ((F.col("n") - 1) * F.col("size")).alias("own"))
    own = own.select(_prefix("front", "d").alias("front"), "own").groupBy("front").agg(F.sum("own").alias("own"))
    inner = high.where("depth > 0").groupBy(up.alias("front")).agg(F.count("*").alias("inner"))
    parents = high.select(F.col("front").alias("up"), F.col("least").alias("parent_conv_id"))
    ends = enders.select(F.col("ts").alias("front"), "ends")
    summed = high.withColumn("up", F.when(F.col("depth") > 0, up)).join(own, "front", "left").join(inner, "front", "left").join(ends, "front", "left").join(parents, "up", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    summed = summed.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), (F.col("child") + zero("inner")).alias("n_children"),
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), (F.col("below") + zero("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int").alias("salt")
    asked = tops.drop("parent_conv_id").withColumn("salt", salt).withColumnRenamed("front", "up")
    met = asked.join(parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["up", "salt"])
    return built.where("front is null").select(*summed.columns).unionByName(met.select(*summed.columns)).unionByName(summed)


def of_rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as ``rebuilt`` shares their starts."""
    return nodes(rebuilt(ordered(conversations)))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda r, b: list_reduce(range(8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(r, b)), 4294967295)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.i, role, text, bytes FROM c JOIN t ON t.conv_id = c.head AND t.i <= h
  UNION ALL SELECT c.conv_id, t.i, role, text, bytes FROM c JOIN t USING (conv_id) WHERE t.i > h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, sha256(len(role) || ':' || role || text) AS x FROM r),
p AS (
  SELECT conv_id, d, bytes, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM o
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY k, d),
kids AS (SELECT left(k, (64 * (d - 1))::INT) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
s AS (
  SELECT p.k, sum(n.own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM n LEFT JOIN kids ON kids.k = n.k JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.k)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, s.leaves AS n_leaves,
  s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN n u ON n.d > 0 AND u.k = left(n.k, (64 * (n.d - 1))::INT)"""
