"""Cox models of any number of subjects: risk-set sums across blocks of falling time.

Subjects lie in blocks by falling time.  A round of fitting makes three passes over the blocks, for
all penalties and folds at once: what a block adds to the risk sets of the blocks after it, what its
events add to the terms of the blocks before it, and the gradient and curvature of all columns.  The
driver keeps a few numbers for each block of ``BLOCK`` subjects, and p x p sums.  A time that goes
on in the next blocks is completed from their first rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.blocked import written

#: Subjects of a block; so many are fitted on the driver, without passes.
BLOCK = 65_536
BLOCKS = "block long, t binary, e binary, fold binary, x binary"


def cohort(df: DataFrame, duration: str, event: str, columns: Sequence[str], key: str | None = None, folds: int = 1, seed: int = 0) -> DataFrame:
    """The subjects in blocks by falling time, written; columns have mean 0 and deviation 1, rows with
    nulls are left out.  A subject's fold follows from its key."""
    own = df.select(
        (F.col(key) if key else F.lit(0)).alias("key"), F.col(duration).cast("double").alias("t"), (F.col(event).cast("int") != 0).alias("e"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns))
    ).na.drop()
    names = [f"x{i}" for i in range(len(columns))]
    seen = own.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    scaled = own.withColumns({c: (F.col(c) - F.lit(seen[f"m_{c}"] or 0.0)) / F.lit(seen[f"s_{c}"] or 1.0) for c in names}).withColumn("fold", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(folds)).cast("int"))
    parts = max(1, -(-seen["n"] // BLOCK))
    # Equal times come into one partition, in blocks one after the other.
    rows = scaled.repartitionByRange(parts, F.col("t").desc()).sortWithinPartitions(F.col("t").desc(), "key")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            while size >= BLOCK:
                whole = pd.concat(held)
                yield block(number, whole[:BLOCK])
                number, held, size = number + 1, [whole[BLOCK:]], size - BLOCK
        if size:
            yield block(number, pd.concat(held))

    def block(number: int, rows: pd.DataFrame) -> pd.DataFrame:
        values = {"t": rows["t"].to_numpy(float), "e": rows["e"].to_numpy(float), "fold": rows["fold"].to_numpy(np.int32), "x": rows[names].to_numpy(float)}
        return pd.DataFrame({"block": [number], **{k: [v.tobytes()] for k, v in values.items()}})

    return written(rows.select("t", "e", "fold", *names).mapInPandas(pack, BLOCKS), "cohort")


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(time, event, fold, columns) of a block."""
    t = np.frombuffer(row.t)
    return t, np.frombuffer(row.e), np.frombuffer(row.fold, np.int32), np.frombuffer(row.x).reshape(len(t), -1)


def _each(blocks: DataFrame, make, width: int, extra: DataFrame | None = None) -> np.ndarray:
    """(blocks, ...) of ``make(row)``, arrays of a fixed size, in the order of blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"block": [row.block], "out": [np.asarray(make(row), float).tobytes()]})

    rows = (blocks if extra is None else _beside(blocks, extra)).mapInPandas(run, "block long, out binary").toPandas().sort_values("block")
    return np.stack([np.frombuffer(v) for v in rows["out"]]).reshape(len(rows), -1, width)


def _beside(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """Blocks with the numbers told to them.  Those go to all tasks, so that blocks never pass the driver."""
    return blocks.join(F.broadcast(told), "block")


def _told(blocks: DataFrame, order: list[int], values: np.ndarray) -> DataFrame:
    """(block, told): some numbers for each block."""
    rows = [(b, v.tobytes()) for b, v in zip(order, np.ascontiguousarray(values), strict=True)]
    return blocks.sparkSession.createDataFrame(rows, "block long, told binary")


def _weights(x: np.ndarray, fold: np.ndarray, model: tuple[np.ndarray, int]) -> np.ndarray:
    """Relative risks; 0 for subjects of the fold that a model leaves out."""
    beta, out = model
    return np.where(fold == out, 0.0, np.exp(np.clip(x @ beta, -50, 50)))


def _risks(row, told: np.ndarray, models) -> Iterator[tuple[np.ndarray, ...]]:
    """(weights, 1/risk at events, its square) of a block's rows for each model."""
    t, e, fold, x = opened(row)
    last = np.searchsorted(-t, -t, "right") - 1
    for (before, rest), model in zip(told, models, strict=True):
        w = _weights(x, fold, model)
        risk = before + np.cumsum(w)[last] + np.where(t == t[-1], rest, 0.0)
        add = np.where((e > 0) & (fold != model[1]), 1 / np.maximum(risk, 1e-300), 0.0)
        yield w, add, add * add


def sums(blocks: DataFrame, models: list[tuple[np.ndarray, int]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(subjects, gradient, curvature) of the partial likelihood (Breslow) for each (coefficients,
    fold left out), of all columns."""
    ends = blocks.select("block", "t").mapInPandas(_ends, "block long, first double, last double").toPandas().sort_values("block")
    order, first, last = ends["block"].tolist(), ends["first"].to_numpy(), ends["last"].to_numpy()
    count = len(order)
    # Whether a block's last time goes on in the next one, and whether a block has one time only.
    on, whole = np.r_[last[:-1] == first[1:], False], first == last

    def weigh(row):
        t, _, fold, x = opened(row)
        return [(w.sum(), w[t == t[0]].sum()) for w in (_weights(x, fold, m) for m in models)]

    w = _each(blocks, weigh, 2)
    before, rest = np.cumsum(w[:, :, 0], 0) - w[:, :, 0], np.zeros(w.shape[:2])
    for b in range(count - 2, -1, -1):
        if on[b]:
            rest[b] = w[b + 1, :, 1] + (rest[b + 1] if whole[b + 1] else 0)
    told = np.stack([before, rest], 2)

    def events(row):
        t = np.frombuffer(row.t)
        tail = t == t[-1]
        return [(a.sum(), b.sum(), a[tail].sum(), b[tail].sum()) for _, a, b in _risks(row, np.frombuffer(row.told).reshape(-1, 2), models)]

    a = _each(blocks, events, 4, _told(blocks, order, told))
    after, tie = np.cumsum(a[::-1, :, :2], 0)[::-1] - a[:, :, :2], np.zeros((count, len(models), 2))
    for b in range(1, count):
        if on[b - 1]:
            tie[b] = a[b - 1, :, 2:] + (tie[b - 1] if whole[b - 1] else 0)
    told = np.concatenate([told, after, tie], 2)
    p = len(models[0][0])

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, out = np.zeros(len(models)), np.zeros((len(models), p + 1, p))
        for frame in frames:
            for row in frame.itertuples():
                t, e, fold, x = opened(row)
                start, own = np.searchsorted(-t, -t, "left"), np.frombuffer(row.told).reshape(-1, 6)
                later = lambda v: np.cumsum(v[::-1])[::-1][start]  # noqa: B023, E731
                for i, (w, one, two) in enumerate(_risks(row, own[:, :2], models)):
                    inn, head = fold != models[i][1], t == t[0]
                    s1 = later(one) + own[i, 2] + np.where(head, own[i, 4], 0)
                    s2 = later(two) + own[i, 3] + np.where(head, own[i, 5], 0)
                    g, h = np.where(inn, e - w * s1, 0), np.where(inn, np.maximum(w * s1 - w * w * s2, 1e-10), 0)
                    n[i] += inn.sum()
                    out[i, 0] += x.T @ g
                    out[i, 1:] += (x * h[:, None]).T @ x
        yield pd.DataFrame({"n": [n.tobytes()], "out": [out.tobytes()]})

    rows = _beside(blocks, _told(blocks, order, told)).mapInPandas(total, "n binary, out binary").collect()
    n = sum(np.frombuffer(r["n"]) for r in rows)
    out = sum(np.frombuffer(r["out"]).reshape(len(models), p + 1, p) for r in rows)
    return [(int(n[i]), out[i, 0], out[i, 1:]) for i in range(len(models))]


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        times = [np.frombuffer(t) for t in frame["t"]]
        yield pd.DataFrame({"block": frame["block"], "first": [t[0] for t in times], "last": [t[-1] for t in times]})


def descend(n: int, gradient: np.ndarray, curve: np.ndarray, beta: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Coordinate descent on the penalised quadratic approximation around ``beta``."""
    at, new = curve @ beta + gradient, beta.copy()
    for _ in range(1000):
        before = new.copy()
        for k in range(len(new)):
            u = (at[k] - curve[k] @ new + curve[k, k] * new[k]) / n
            new[k] = np.sign(u) * max(abs(u) - alpha * l1_ratio, 0) / (curve[k, k] / n + alpha * (1 - l1_ratio) + 1e-12)
        if np.abs(new - before).max(initial=0) < 1e-9:
            break
    return new


def fits(blocks: DataFrame, settings: list[tuple[float, float, int]], starts: list[np.ndarray], rounds: int = 100) -> list[np.ndarray]:
    """Coefficients for each (alpha, l1 ratio, fold left out; -1 for none), all in the same passes."""
    betas, going = [b.copy() for b in starts], list(range(len(settings)))
    for _ in range(rounds):
        if not going:
            break
        found = sums(blocks, [(betas[i], settings[i][2]) for i in going])
        still = []
        for i, (n, gradient, curve) in zip(going, found, strict=True):
            new = descend(max(n, 1), gradient, curve, betas[i], settings[i][0], settings[i][1])
            if np.abs(new - betas[i]).max(initial=0) >= 1e-6:
                still.append(i)
            betas[i] = new
        going = still
    return betas


def scored(blocks: DataFrame, models: list[tuple[int, np.ndarray, int]]) -> DataFrame:
    """(model, s, t, e): the linear predictor of the subjects of each (model, coefficients, fold); -1
    stands for all folds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                t, e, fold, x = opened(row)
                for model, beta, own in models:
                    at = (fold == own) | (own < 0)
                    yield pd.DataFrame({"model": model, "s": x[at] @ beta, "t": t[at], "e": e[at] > 0})

    return blocks.mapInPandas(run, "model int, s double, t double, e boolean")
