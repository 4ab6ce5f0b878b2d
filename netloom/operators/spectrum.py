"""Leading eigenvectors of normalised graphs of any size, and cuts by turning them.

A graph is a table (i, j, w) with each edge from both ends and positive weights; its matrix is
w / sqrt(d_i d_j).  A block of vectors is filtered by Chebyshev polynomials of the matrix, which grow
fastest at its upper end, and turned to Ritz vectors, until their residuals are small.  A product with
the matrix is one join of links and rows and a sum by node; what the driver holds are matrices of a
few dozen rows.  Graphs of few links are held there whole, by the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.blocked import written
from netloom.operators.communities import degrees

#: Products in a filter, filters at most, vectors beyond those asked for.
DEGREE, ROUNDS, EXTRA = 8, 15, 4
#: A residual below this is none.
SMALL = 1e-4
#: Turns of a cut at most.
TURNS = 40

Step = Callable[[np.ndarray], np.ndarray]


class Held:
    """Rows x of nodes ``ids`` and links (i, j, s) between them, in the driver's memory."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, links: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.ids, self.x, self.links = ids, x, links

    def sums(self, f: Step) -> np.ndarray:
        """f adds up over parts of the rows."""
        return f(self.x)

    def least(self, f: Step) -> np.ndarray:
        """The row of the least f, of equal ones that of the smallest node."""
        return self.x[np.lexsort((self.ids, np.round(f(self.x), 9)))[0]]

    def stepped(self, lo: int, hi: int, f: Step) -> Held:
        """f of the rows with the matrix's product with columns lo to hi beside them."""
        i, j, s = self.links
        product = np.stack([np.bincount(i, s * self.x[j, c], len(self.x)) for c in range(lo, hi)], 1)
        return self.mapped(lambda _: f(np.hstack([self.x, product])))

    def mapped(self, f: Step) -> Held:
        return Held(self.ids, f(self.x), self.links)

    def table(self, spark) -> DataFrame:
        rows = [(int(v), [float(c) for c in x]) for v, x in zip(self.ids, self.x, strict=True)]
        return spark.createDataFrame(rows, "v long, x array<double>")


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_list()).astype(float)


class Spread:
    """The same over tables (v, x) and (i, j, s)."""

    def __init__(self, rows: DataFrame, links: DataFrame, width: int):
        self.rows, self.links, self.width = rows, links, width

    def sums(self, f: Step) -> np.ndarray:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for frame in frames:
                if len(frame):
                    own = f(_matrix(frame))
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"part": [total.ravel().tolist()], "shape": [list(total.shape)]})

        parts = self.rows.select("x").mapInPandas(part, "part array<double>, shape array<int>")
        found = parts.select("shape", F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"), F.first("shape").alias("shape")).orderBy("at").collect()
        return np.array([r["value"] for r in found]).reshape(found[0]["shape"])

    def least(self, f: Step) -> np.ndarray:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for frame in frames:
                if len(frame):
                    own = frame.assign(f=np.round(f(_matrix(frame)), 9)).sort_values(["f", "v"]).head(1)
                    best = own if best is None else pd.concat([best, own]).sort_values(["f", "v"]).head(1)
            if best is not None:
                yield best

        return np.array(self.rows.mapInPandas(part, "v long, x array<double>, f double").orderBy("f", "v").first()["x"])

    def stepped(self, lo: int, hi: int, f: Step) -> Spread:
        # Rows are shuffled: small enough for a broadcast, they would pass the driver at every product.
        sent = self.rows.select(F.col("v").alias("j"), F.slice("x", lo + 1, hi - lo).alias("y")).hint("merge")
        product = self.links.join(sent, "j").groupBy(F.col("i").alias("v")).agg(F.array(*(F.sum(F.col("s") * F.get("y", F.lit(c))) for c in range(hi - lo))).alias("p"))
        beside = self.rows.join(product.hint("merge"), "v").select("v", F.concat("x", "p").alias("x"))
        return Spread(beside, self.links, self.width + hi - lo).mapped(f)

    def mapped(self, f: Step) -> Spread:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"v": frame["v"], "x": list(f(_matrix(frame)))})

        width = f(np.zeros((1, self.width))).shape[1]
        return Spread(written(self.rows.mapInPandas(part, "v long, x array<double>"), "spectrum"), self.links, width)

    def table(self, spark) -> DataFrame:
        return self.rows


def _ritz(products: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, turn, residuals), values falling, of [y, A y]^T [y, A y] for a block y of p vectors."""
    g, h, a = products[:p, :p], products[:p, p:], products[p:, p:]
    s, u = np.linalg.eigh((g + g.T) / 2)
    keep = s > 1e-13 * max(s[-1], 1e-300)
    white = u[:, keep] / np.sqrt(s[keep])
    values, q = np.linalg.eigh(white.T @ (h + h.T) @ white / 2)
    values, turn = values[::-1], (white @ q)[:, ::-1]
    left = np.einsum("ij,ik,kj->j", turn, a, turn) - values**2
    return values, turn, np.sqrt(np.maximum(left, 0))


def _start(graph: DataFrame, p: int, seed: int, few: int) -> Held | Spread:
    """Rows of p hashed numbers from -1 to 1, and the normalised links."""
    own = degrees(graph)
    at = lambda end, out: own.select(F.col("v").alias(end), F.col("k").alias(out))
    links = graph.join(at("i", "_a"), "i").join(at("j", "_b"), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("s"))
    value = lambda c: F.xxhash64("v", F.lit(seed), F.lit(c)) / F.lit(2.0**63)
    rows = own.select("v", F.array(*(value(c) for c in range(p))).alias("x"))
    if graph.count() > few:
        return Spread(written(rows, "spectrum"), written(links, "links"), p)
    frame, first = links.toPandas().sort_values(["i", "j"]), rows.toPandas().sort_values("v")
    ids = first["v"].to_numpy(np.int64)
    return Held(ids, _matrix(first), (np.searchsorted(ids, frame["i"]), np.searchsorted(ids, frame["j"]), frame["s"].to_numpy(float)))


def leading(graph: DataFrame, k: int, seed: int = 0, few: int = 200_000) -> tuple[Held | Spread, np.ndarray]:
    """(rows of eigenvectors, values) of the ``k`` largest eigenvalues of a graph (i, j, w), fewer where
    it has fewer nodes.  Graphs of at most ``few`` rows are held on the driver."""
    p = k + EXTRA
    block = _start(graph, p, seed, few)
    for number in range(ROUNDS):
        beside = block.stepped(0, p, lambda x: x)
        values, turn, left = _ritz(beside.sums(lambda x: x.T @ x), p)
        p, last = len(values), number + 1 == ROUNDS or left[:k].max() < SMALL
        if last:
            break
        # The filter damps all below the least Ritz value.
        low = min(max(values[-1], -0.9), 1 - 1e-6)
        half, middle = (low + 1) / 2, (low - 1) / 2
        block = beside.mapped(lambda x, t=turn, e=half, c=middle: np.hstack([x[:, : len(t)] @ t, (x[:, len(t) :] @ t - c * (x[:, : len(t)] @ t)) / e]))
        for _ in range(DEGREE - 1):
            block = block.stepped(p, 2 * p, lambda x, p=p, e=half, c=middle: np.hstack([x[:, p : 2 * p], 2 * (x[:, 2 * p :] - c * x[:, p : 2 * p]) / e - x[:, :p]]))
        block = block.mapped(lambda x, p=p: x[:, p:])
    k = min(k, p)
    return beside.mapped(lambda x, t=turn, k=k: x[:, : len(t)] @ t[:, :k]), values[:k]


def discretised(rows: Held | Spread) -> Held | Spread:
    """A column of labels: each row's largest entry once the rows, at unit length, are turned towards
    the axes.  The first turn is made of rows that lie apart, further ones fit rows to their labels."""
    unit = rows.mapped(lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None])
    picks = [unit.least(lambda x: np.zeros(len(x)))]
    k = len(picks[0])
    while len(picks) < k:
        so_far = np.array(picks).T
        picks.append(unit.least(lambda x, r=so_far: np.abs(x @ r).sum(1)))
    turn, best = np.array(picks).T, -np.inf
    for _ in range(TURNS):

        def fit(x: np.ndarray, turn: np.ndarray = turn) -> np.ndarray:
            return x.T @ np.eye(k)[(x @ turn).argmax(1)]

        u, s, v = np.linalg.svd(unit.sums(fit))
        if s.sum() <= best * (1 + 1e-9):
            break
        turn, best = u @ v, s.sum()
    return unit.mapped(lambda x: (x @ turn).argmax(1)[:, None].astype(float))
