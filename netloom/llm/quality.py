"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics are computed for every whole text, a slice of documents at a time with numpy.
The trees are fitted on the driver from a sample of labelled documents whose size is bounded
(``SAMPLE`` rows, those with the smallest md5 of their id): features are binned once, a level
of a tree is grown from histograms of gradients.  A model is a few arrays, node by node, that
all rows walk through together.

Defined results: an empty or null text has a score too; a null id is never held out and its
label is unknown; several labels of one id count as their mean; without labels of both kinds
the score is the share of good ones (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import WORD, held_out, texts, trim

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 5.0

#: Classes of bytes: letters, digits, white space, line ends, common and other punctuation, the rest.
LOWER, UPPER, DIGIT, SPACE, LINE, POINT, MARK, PIPE, HIGH, CONTROL = range(10)
_CLASS = np.full(256, CONTROL, np.uint8)
for _chars, _of in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t", SPACE), (b"\n\r\x0b\x0c", LINE), (b".,;:'\"()-?", POINT), (b"!#$%&*+/<=>@[]^_`{}~\\", MARK), (b"|", PIPE)):
    _CLASS[list(_chars)] = _of
_CLASS[128:] = HIGH
FEATURES = 10 + 9


def features(data: list[bytes]) -> np.ndarray:
    """A row of statistics for each text: shares of byte classes, then of words and lines."""
    out = np.zeros((len(data), FEATURES))
    for i, text in enumerate(data):
        size = len(text)
        shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10) / max(size, 1)
        words, lines = WORD.findall(text), text.split(b"\n")
        n, m = len(words), len(lines)
        kinds, kept = len(set(words)), len(set(lines))
        last = np.bincount(_CLASS[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)], minlength=10) / max(n, 1)
        out[i, :10] = shares
        out[i, 10:] = (
            np.log1p(size), np.log1p(n), size / max(n, 1), np.log1p(kinds) / np.log1p(max(n, 1)),
            last[MARK], sum(map(bytes.isupper, words)) / max(n, 1), kept / m, n / m, max(map(len, words), default=0),
        )
    return out


class Trees(NamedTuple):
    """Complete trees of one depth, level by level: (trees, inner nodes) and (trees, leaves)."""

    base: float
    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; a split must leave LEAST rows a side."""
    inner = (1 << DEPTH) - 1
    mean = (y.mean() if len(y) else 0.5).clip(1e-6, 1 - 1e-6) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(set(y.tolist())) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    flat = bins + np.arange(x.shape[1]) * BINS
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, above, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * x.shape[1] * BINS + flat).ravel()
            shape, size = (width, x.shape[1], BINS), width * x.shape[1] * BINS
            g, h, n = (np.bincount(at, np.repeat(w, x.shape[1]), size).reshape(shape).cumsum(2) for w in (grad, hess, np.ones(len(y))))
            value = lambda g, h: g * g / (h + L2)
            gain = value(g, h) + value(g[..., -1:] - g, h[..., -1:] - h) - value(g[..., -1:], h[..., -1:])
            gain[(n < LEAST) | (n[..., -1:] - n < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-9 and cut < len(edges[f]):
                    feature[first + k], above[first + k] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > above[node])
        ends = node - inner
        leaf = -RATE * np.bincount(ends, grad, inner + 1) / (np.bincount(ends, hess, inner + 1) + L2)
        total += leaf[ends]
        trees.append((feature, above, leaf))
    return Trees(base, *(np.stack(part) for part in zip(*trees, strict=True)))


def _measured(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of each row with its statistics."""
    cut = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *names)
    kept = [f for f in cut.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(list(texts(batch))).ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], x], [*names, "x"])

    return cut.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, sample: int = SAMPLE) -> Trees:
    """Fit on labelled documents whose crc32 remainder is not 1, ``sample`` of them at most."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (key != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("l_doc_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.md5(F.col("l_doc_id").cast("string").cast("binary")), "l_doc_id").limit(sample)
    # At most ``sample`` ids and labels, so they may go to every executor.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_doc_id"))
    # At most ``sample`` short rows reach the driver, but for documents whose id repeats: one each.
    rows = _measured(chosen, "doc_id", "y").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Trees, mod: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, p = batch.column(0), shared.value.score(features(list(texts(batch))))
            out = [held_out(i, mod) for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=pa.schema(fields))
        trim()

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The documents that the model takes for good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(shared.value.score(features(list(texts(batch, "q_text")))) >= 0.5)
            yield batch.select([c for c in batch.schema.names if c != "q_text"]).filter(good)
        trim()

    plain = docs.select(*(F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(names)), F.col("text").cast("string").alias("q_text"))
    out = plain.mapInArrow(run, plain.drop("q_text").schema)
    return out.select(*(F.col(f"p_{i}").alias(c) for i, c in enumerate(names)))
