"""Language-model scoring by prediction by partial matching (PPM, escape method C).

The model is a trie of byte contexts with the counts of the symbols that followed them in the
training documents.  A text is its lower-cased words, each closed by a space, then one end
symbol; it starts after a space.  The context of a byte is the ``ORDER`` bytes before it, across
words.  A symbol is predicted from the longest context that the trie has; where it hasn't
followed, an escape (distinct symbols / (occurrences + distinct symbols)) leads to the next
shorter context, in which the symbols of the longer one are excluded; below order 0 all 257
symbols not yet excluded are alike.

A pass over the text leaves documents as word numbers and each block's distinct words (see
``common.blocks``), and the block's distinct longest contexts with their symbols.  From a word's
fifth byte on a context lies within the word, so it is made once per distinct word; the first
four bytes are made per position.  Words meet by hash and contexts by their last two bytes, so
that every context finds its shorter ones: counts are summed (first within a task, then per
deal), priced once per distinct context, and costs go back to the blocks, where every position
looks up its own.  A deal's sums are all that a task holds; what the blocks ask streams past
them, hot deals in several tasks.  Only contexts of at most one byte (at most 257 x 257 counts,
a fixed bound) are sent to all tasks.

Defined results: a null text is empty and consists of the end token alone; a null id is never
held out; repeated rows each have a row, and count as often as they occur; a text or word of any
length is coded whole; other columns are ignored; with no training documents every symbol costs
log10(257) and c is 0 throughout; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import (
    SEP, WORD, Dealt, blocks, grouped, pack_doubles, pack_ints, pack_words, partitions, read_block, saved, squeeze, swell, trim, unpack_doubles,
    unpack_ints, unpack_words,
)

ORDER, SYMBOLS, END = 5, 257, 256
SPACE = 32
#: A key holds, from the top, the order, ORDER context bytes and nine bits of symbol.
_SYM, _CTX = np.int64(9), np.int64(8 * ORDER)
_TOP = np.int64(_SYM + _CTX)
#: Positions that one numpy call handles; contexts that a task sums before they leave it.
CHUNK, SUMS = 1 << 20, 1 << 22
#: Contexts are dealt by a hash of their last two bytes; rows of contexts of one byte.
DEALS_LOG = 9
ONES = -1 - (1 << DEALS_LOG)
#: Blocks that one task answers for a deal, at most.
ASKED = 1 << 16


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _windows(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, window, back, part) of each byte but the first of every part: ``window`` has the
    ORDER bytes before it, of which the part has ``back``; SEP stands for the end symbol."""
    lens = np.fromiter(map(len, batch), np.int64, len(batch))
    flat = np.frombuffer(b"".join(batch), np.uint8).astype(np.int64)
    flat[flat == SEP[0]] = END
    start = np.repeat(np.cumsum(lens) - lens, lens)
    back = np.arange(len(flat)) - start
    window = np.zeros(len(flat), np.int64)
    for k in range(1, ORDER + 1):
        window[k:] |= np.where(back[k:] >= k, flat[:-k], 0) << (8 * (k - 1))
    coded = back > 0
    return flat[coded], window[coded], back[coded], np.repeat(np.arange(len(batch)), lens)[coded]


def _key(order, window, symbol) -> np.ndarray:
    """The key of a context of ``order`` bytes and a symbol."""
    order = np.asarray(order, np.int64)
    return (order << _TOP) | ((window & ((np.int64(1) << (8 * order)) - 1)) << _SYM) | symbol


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(keys: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the number of their flags: one sort of plain numbers."""
    both = np.sort((keys << 1) | flag)
    keys = both >> 1
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(both & 1, first) if len(first) else both


class Sums:
    """Distinct keys with their counts; what is added waits until it is as much as is there."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.wait.append((keys, counts))
        self.size += len(keys)
        if self.size > max(len(self.keys), 1 << 18):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.wait:
            self.keys, self.counts = _summed(np.concatenate([self.keys, *(k for k, _ in self.wait)]), np.concatenate([self.counts, *(n for _, n in self.wait)]))
            self.wait, self.size = [], 0
        return self.keys, self.counts


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences."""
    return squeeze(np.diff(keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(swell(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel())


# ---- the positions of a block --------------------------------------------------------------------


class Coded:
    """A block's texts as keys of longest contexts and symbols.

    ``own`` are the keys from the fifth byte of each distinct word on, ``own_word`` their words.
    ``heads[k]`` holds a word's k-th byte with the bytes of the word before it and the space
    before the word, -1 where the word is closed already; the end symbol is the last "word".
    """

    def __init__(self, vocabulary: list[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        n = len(vocabulary)
        self.heads = np.full((ORDER - 1, n + 1), -1, np.int64)
        self.heads[0, n] = (SPACE << int(_SYM)) | END
        # The last bytes of a space and the word, and how many: what the next word sees before its space.
        self.tail, self.reach = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.vocabulary, self.end = vocabulary, n
        # Tokens with an end for each document; a token's place in its document.
        ends = np.cumsum(lens.astype(np.int64))
        self.tokens = np.insert(flat.astype(np.int64), ends, n)
        sizes = lens.astype(np.int64) + 1
        self.doc = np.repeat(np.arange(len(lens)), sizes)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def own(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, words) within distinct words; fills in what ``first`` needs, so it comes before."""
        upto = np.cumsum(np.fromiter(map(len, self.vocabulary), np.int64, self.end) + 2)
        start = 0
        while start < self.end:
            stop = max(start + 1, int(np.searchsorted(upto, CHUNK + (upto[start - 1] if start else 0))))
            symbol, window, back, part = _windows([b" " + w + b" " for w in self.vocabulary[start:stop]])
            coded = (window << _SYM) | symbol
            last = upto[start:stop] - (upto[start - 1] if start else 0) - np.arange(1, stop - start + 1) - 1
            begin = np.r_[0, last[:-1] + 1]
            for k in range(ORDER - 1):
                self.heads[k, start:stop] = np.where(last - begin >= k, coded[np.minimum(begin + k, len(coded) - 1)], -1)
            self.tail[start:stop] = window[last] & ((np.int64(1) << (8 * (ORDER - 1))) - 1)
            self.reach[start:stop] = np.minimum(back[last], ORDER - 1)
            inner = back >= ORDER
            yield (np.int64(ORDER) << _TOP) | coded[inner], part[inner] + start
            start = stop

    def first(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, at, keys): the first bytes of tokens start..end, ``at`` their tokens."""
        for start in range(0, len(self.tokens), CHUNK):
            end = min(start + CHUNK, len(self.tokens))
            token, place = self.tokens[start:end], self.place[start:end]
            # Two words back are enough: with their spaces they have ORDER - 1 bytes or more.
            before = [np.where(place >= b, self.tokens[np.maximum(np.arange(start, end) - b, 0)], self.end) for b in (1, 2)]
            tail = self.tail[before[0]] | (self.tail[before[1]] << (8 * self.reach[before[0]]))
            reach = self.reach[before[0]] + self.reach[before[1]]
            for k in range(ORDER - 1):
                head = self.heads[k, token]
                at = np.flatnonzero(head >= 0)
                some = np.int64(ORDER - 1 - k)
                order = k + 1 + np.minimum(reach[at], some)
                yield start, end, at + start, (order << _TOP) | ((tail[at] & ((np.int64(1) << (8 * some)) - 1)) << (8 * (k + 1) + _SYM)) | head[at]


def _running(block: int, dealt: Dealt, learnt: np.ndarray) -> Iterator[dict]:
    """Rows of a block's distinct longest contexts and symbols (a: keys, b: counts in training
    documents), by deal, and of its contexts of one byte."""
    coded, sums = Coded(dealt.words, dealt.flat, dealt.lens), Sums()
    for keys, part in coded.own():
        sums.add(*_summed(keys, learnt[part]))
    flag = np.array([f for _, f in dealt.docs], np.int64)
    for _, _, at, keys in coded.first():
        sums.add(*_counted(keys, flag[coded.doc[at]]))
    keys, counts = sums.close()
    one, n = _summed(_key(1, (keys >> _SYM) & 255, keys & 511), counts)
    yield {"block": block, "bucket": ONES, "a": _pack_keys(one), "b": pack_ints(n), "c": b""}
    yield from ({"block": block, **row, "c": b""} for row in _deal(keys, counts))


def _deal(keys: np.ndarray, counts: np.ndarray) -> Iterator[dict]:
    """Keys in order as rows, one for each deal of contexts that end alike."""
    deal = ((((keys >> _SYM) & 0xFFFF) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - DEALS_LOG)
    order = np.argsort(deal, kind="stable")
    keys, counts, deal = keys[order], counts[order], deal[order]
    cuts = np.flatnonzero(deal[1:] != deal[:-1]) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if i < j:
            yield {"bucket": -1 - int(deal[i]), "a": _pack_keys(keys[i:j]), "b": pack_ints(counts[i:j])}


def _ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_unpack_keys(a.as_py())), pa.array(unpack_ints(b.as_py()).astype(np.int64))], ["key", "n"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the blocks of a task, before anything is dealt out; contexts that only texts
    held out have count 0 and stay, since they want a price."""
    schema = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def rows() -> Iterator[dict]:
        sums = Sums()
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                sums.add(_unpack_keys(a.as_py()), unpack_ints(b.as_py()).astype(np.int64))
                if len(sums.keys) >= SUMS:
                    yield from _deal(*sums.close())
                    sums = Sums()
        yield from _deal(*sums.close())

    yield from grouped(rows(), schema, 64)


def _nested(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct longest contexts with their counts, and all shorter ones of two bytes and more."""
    levels, carried = [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for order in range(ORDER, 1, -1):
        own = keys >> _TOP == order
        levels.append(_summed(np.concatenate([keys[own], carried[0]]), np.concatenate([sums[own], carried[1]])))
        k, n = levels[-1]
        carried = _key(order - 1, k >> _SYM, k & 511), n
    return tuple(np.concatenate(x) for x in zip(*levels[::-1], strict=True))


def _priced(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Rows sorted by deal: all contexts that end alike are summed and priced, in rows of CHUNK."""
    schema = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def rows() -> Iterator[dict]:
        deal, sums = None, Sums()

        def told() -> Iterator[dict]:
            keys, counts = sums.close()
            log = costs(*_nested(keys, counts), keys, shared.value)
            for i in range(0, len(keys), CHUNK):
                yield {"bucket": deal, "a": _pack_keys(keys[i : i + CHUNK]), "b": pack_doubles(log[i : i + CHUNK])}

        for batch in batches:
            for bucket, a, b in zip(batch.column("bucket").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if bucket != deal:
                    yield from told()
                    deal, sums = bucket, Sums()
                sums.add(_unpack_keys(a.as_py()), unpack_ints(b.as_py()).astype(np.int64))
        yield from told()

    yield from grouped(rows(), schema, 16)
    trim()


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by deal, salt and block, prices (block -1) first: the costs each block asks for."""
    schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("costs", pa.binary())])

    def rows() -> Iterator[dict]:
        at, known, look = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["salt"]) != at:
                    at, known, look = (row["bucket"], row["salt"]), [], None
                if row["block"] < 0:
                    known.append((_unpack_keys(row["a"]), unpack_doubles(row["b"])))
                    continue
                look = look or Prices(known)
                yield {"block": row["block"], "keys": row["a"], "costs": pack_doubles(look(_unpack_keys(row["a"])))}

    yield from grouped(rows(), schema, 64)
    trim()


class Prices:
    """Costs by key: a table of hashes, and a binary search for keys that another one displaced."""

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        keys, log = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0)), *parts, strict=True))
        order = np.argsort(keys)
        self.keys, self.log = keys[order], log[order]
        self.shift = np.uint64(64 - max(8, (8 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._hash(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        at = self.table[self._hash(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.log[at]


def _text_costs(vocabulary: list[bytes], flat: np.ndarray, lens: np.ndarray, prices: Prices) -> np.ndarray:
    """The cost of each of a block's texts."""
    coded = Coded(vocabulary, flat, lens)
    within = np.zeros(len(vocabulary) + 1)
    for keys, part in coded.own():
        within += np.bincount(part, prices(keys), len(within))
    out = np.bincount(coded.doc, within[coded.tokens], len(lens))
    for _, _, at, keys in coded.first():
        out += np.bincount(coded.doc[at], prices(keys), len(lens))
    return out


class Short:
    """Counts of contexts of no and of one byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.zero, self.one = np.zeros(SYMBOLS, np.int64), np.zeros((256, SYMBOLS), np.int64)
        order, symbol, byte = keys >> _TOP, keys & 511, (keys >> _SYM) & 255
        self.zero[symbol[order == 0]] = counts[order == 0]
        self.one[byte[order == 1], symbol[order == 1]] = counts[order == 1]


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def costs(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, short: Short) -> np.ndarray:
    """log10 probability of each ``asked`` key (a longest context and its symbol).

    ``keys``/``counts``: distinct and sorted, all trained contexts of two bytes and more that end
    as those asked do.  Contexts are nested: what followed a context followed its shorter ones, so
    the symbols excluded at a level are those of the level above.
    """
    trained = counts > 0
    keys, counts = keys[trained], counts[trained]
    # Contexts of one level: id -> total, distinct; and, of the shorter context with this one's
    # symbols excluded, what is left: total and distinct.
    level: list[tuple[np.ndarray, ...]] = [(np.zeros(1, np.int64), np.array([short.zero.sum()]), np.array([(short.zero > 0).sum()]))]
    seen = np.flatnonzero(short.one.sum(1))
    level.append((seen, short.one[seen].sum(1), (short.one[seen] > 0).sum(1)))
    left: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1), np.zeros(1))]
    inside = (short.one[seen] > 0).astype(np.int64)
    left.append((short.zero.sum() - inside @ short.zero, (short.zero > 0).sum() - inside.sum(1)))

    def count_of(order: int, ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if order == 0:
            return short.zero[symbol]
        if order == 1:
            return short.one[ctx, symbol]
        k = (np.int64(order) << _TOP) | (ctx << _SYM) | symbol
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        return np.where(keys[at] == k, counts[at], 0) if len(keys) else np.zeros(len(k), np.int64)

    for order in range(2, ORDER + 1):
        lo, hi = np.searchsorted(keys, [np.int64(order) << _TOP, np.int64(order + 1) << _TOP])
        own, n = (keys[lo:hi] >> _SYM) & ((np.int64(1) << _CTX) - 1), counts[lo:hi]
        ctx, first = np.unique(own, return_index=True)
        total = np.add.reduceat(n, first) if len(first) else n
        distinct = np.diff(np.r_[first, len(own)])
        shorter = own & ((np.int64(1) << (8 * (order - 1))) - 1)
        above = count_of(order - 1, shorter, keys[lo:hi] & 511)
        above = np.add.reduceat(above, first) if len(first) else above
        parent = ctx & ((np.int64(1) << (8 * (order - 1))) - 1)
        at = np.searchsorted(level[order - 1][0], parent)
        level.append((ctx, total, distinct))
        left.append((level[order - 1][1][at] - above, level[order - 1][2][at] - distinct) if len(ctx) else (total, distinct))

    symbol, window, reach = asked & 511, (asked >> _SYM) & ((np.int64(1) << _CTX) - 1), asked >> _TOP
    out, done = np.zeros(len(asked)), np.zeros(len(asked), bool)
    from_above = np.full(len(asked), -1, np.int64)  # the longer context just left, by its place in its level
    for order in range(ORDER, -1, -1):
        ctx = window & ((np.int64(1) << (8 * order)) - 1)
        ids, total, distinct = level[order]
        if not len(ids):
            continue
        at = np.minimum(np.searchsorted(ids, ctx), len(ids) - 1)
        here = ~done & (reach >= order) & (ids[at] == ctx) & (total[at] > 0)
        t, d = total[at], distinct[at]
        if order < ORDER and len(left[order + 1][0]):
            up = np.maximum(from_above, 0)
            excluded = from_above >= 0
            t, d = np.where(excluded, left[order + 1][0][np.minimum(up, len(left[order + 1][0]) - 1)], t), np.where(excluded, left[order + 1][1][np.minimum(up, len(left[order + 1][1]) - 1)], d)
        n = np.zeros(len(asked), np.int64)
        n[here] = count_of(order, ctx[here], symbol[here])
        hit, miss = here & (n > 0), here & (n == 0)
        out[hit] += _log(n[hit]) - _log(t[hit] + d[hit])
        # A context with nothing left to predict is left for certain.
        some = miss & (d > 0)
        out[some] += _log(d[some]) - _log(t[some] + d[some])
        done |= hit
        from_above = np.where(miss, at, from_above)
    rest = ~done
    out[rest] -= np.log10(SYMBOLS - int(level[0][2][0]))
    return out


def score(docs: DataFrame, mod: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``base_score`` is that of a word model with half a count added to every token; ``score`` is
    the log10 probability of the text under PPM.  Both learn from documents whose crc32
    remainder is not 1.
    """
    spark = docs.sparkSession
    parts = max(partitions(spark), 12)
    found, folder = blocks(docs, words, mod, max(64, 2 * parts), "ppm-blocks", _running)
    every = saved(found, "ppm-words")
    found = every.where("bucket >= 0")

    # Distinct words of each bucket with their counts in training documents, over all blocks.
    lexicon_schema = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            bucket, count = None, {}
            packed = lambda: {"bucket": bucket, "words": pack_words(list(count)), "counts": pack_doubles(np.fromiter(count.values(), float, len(count)))}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bucket"] != bucket:
                        if bucket is not None:
                            yield packed()
                        bucket, count = row["bucket"], {}
                    for word, n in zip(unpack_words(row["a"]), unpack_ints(row["c"]).tolist(), strict=True):
                        count[word] = count.get(word, 0) + n
            if bucket is not None:
                yield packed()

        yield from grouped(rows(), lexicon_schema, 8)

    dealt = found.select("bucket", "a", "c").repartition(parts, "bucket").sortWithinPartitions("bucket")
    lexicon_rows = saved(dealt.mapInArrow(lexicon, "bucket int, words binary, counts binary"), "ppm-lexicon")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = unpack_doubles(row["counts"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], ["n", "v"])

    # The end token: one of each training document; the two numbers of the corpus are one row.
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(0)) != 1).count()
    total = lexicon_rows.mapInArrow(counted, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    tokens, kinds = (total[0] or 0) + ends, (total[1] or 0) + (ends > 0)

    few = every.where(F.col("bucket") == ONES).select("a", "b").mapInArrow(_ones, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").collect()
    keys, sums = np.array([r["key"] for r in few], np.int64), np.array([r["n"] for r in few], np.int64)
    none, n = _summed(_key(0, keys, keys & 511), sums)
    shared = spark.sparkContext.broadcast(Short(np.r_[keys, none], np.r_[sums, n]))

    # What each block asks of a deal, and the deal's prices, meet; a deal's rows are at most as
    # many as there are deals, and only those asked by many blocks are salted.
    asked = every.where(f"bucket < 0 and bucket > {ONES}")
    hot = {r["bucket"]: -(-r["n"] // ASKED) for r in asked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(f"n > {ASKED}").collect()}
    salts: Column = F.lit(1)
    if hot:
        salts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in hot.items() for x in pair)), F.col("bucket")), F.lit(1))
    summed = asked.select("bucket", "a", "b").mapInArrow(_combined, "bucket int, a binary, b binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    prices = summed.mapInArrow(partial(_priced, shared=shared), "bucket int, a binary, b binary")
    prices = prices.select("bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(-1).cast("long").alias("block"), "a", "b")
    asked = asked.select("bucket", F.pmod(F.xxhash64("block"), salts).cast("int").alias("salt"), "block", "a", F.lit(None).cast("binary").alias("b"))
    met = prices.unionAll(asked).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "block")
    price = met.mapInArrow(_given, "block long, keys binary, costs binary")

    answer_schema = pa.schema([("block", pa.int64()), ("lids", pa.binary()), ("counts", pa.binary())])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[bytes, float] = {}
        for row in right.to_pylist():
            known.update(zip(unpack_words(row["words"]), unpack_doubles(row["counts"]).tolist(), strict=True))
        out = [{"block": row["block"], "lids": row["b"], "counts": pack_doubles(np.array([known[w] for w in unpack_words(row["a"])], float))} for row in left.to_pylist()]
        return pa.Table.from_pylist(out, answer_schema)

    answers = found.select("block", "bucket", "a", "b").groupBy("bucket").cogroup(lexicon_rows.groupBy("bucket")).applyInArrow(answered, "block long, lids binary, counts binary")

    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    low = np.log10(tokens + 0.5 * (kinds + 1))

    def assemble(table: pa.Table, prices: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        dealt = read_block(folder, rows[0]["block"])
        lids = np.concatenate([unpack_ints(r["lids"]) for r in rows]).astype(np.int64)
        dealt.check(len(lids))
        count = np.zeros(len(lids))
        count[lids] = np.concatenate([unpack_doubles(r["counts"]) for r in rows])
        by_text = _text_costs(dealt.words, dealt.flat, dealt.lens, Prices((_unpack_keys(k.as_py()), unpack_doubles(c.as_py())) for k, c in zip(prices.column("keys"), prices.column("costs"), strict=True)))
        base = np.log10(count + 0.5) - low
        own = np.repeat(np.arange(len(dealt.lens)), dealt.lens)
        end_base, n = float(np.log10(ends + 0.5) - low), len(dealt.lens)
        columns = [
            pa.array([d for d, _ in dealt.docs], pa.int64()), pa.array([not learnt for _, learnt in dealt.docs]), pa.array(dealt.lens.astype(np.int64) + 1),
            pa.array(np.bincount(own, count[dealt.flat] > 0, n).astype(np.int64) + (ends > 0)), pa.array(np.full(n, tokens, np.int64)),
            pa.array(np.bincount(own, base[dealt.flat], n) + end_base), pa.array(by_text),
        ]
        return pa.Table.from_arrays(columns, schema=pa.schema(fields))

    types = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("block").cogroup(price.groupBy("block")).applyInArrow(assemble, types)
