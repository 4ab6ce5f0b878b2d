"""Exact top-k by inner product with a vector-approximation file.

Vectors become whole numbers, floor(256 x).  The approximation file is a table of its own: blocks
of vectors as cells of a grid of 256 steps per dimension, a byte each.  The cells alone bound every
inner product from both sides.  Blocks of queries meet blocks of cells; each task keeps, query by
query, the vectors whose upper bound reaches the k-th largest lower bound it has seen.  The k-th
largest lower bound over all tasks rules out nearly all of these, and only the exact vectors of
the others are fetched, by their row, and read in the order of their upper bounds until the k-th
result beats the next bound.

Query blocks are dealt into groups of GROUP, cell blocks likewise, and a group of queries meets a
group of cells under a key of the two groups' numbers, so no key holds more than GROUP blocks a
side whatever the tables' sizes; Spark broadcasts the queries instead where they are small.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a
null id take no part; vectors of different lengths never meet; rows that repeat an id are vectors
of their own, and a query leaves out only its own row; equal scores go to the smaller vec_id, then
to the row read first; of equal vectors only the k + 1 first can be among the results, so a vector
that many rows share costs no more than k + 1 candidates a task.  Components of any size that
doubles hold 256 times are exact; a result that a long can't hold raises.  Other columns are
ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import grouped, partitions, saved, trim

CANDIDATES, QUERIES = 8192, 1024
STEPS, READ = 256, 16
#: Blocks of each side that share a key; candidates that a task holds before it lets go of them.
GROUP, HELD = 64, 1 << 20


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, dim, whole): the vectors that take part, as whole numbers in doubles."""
    from pyspark import TaskContext

    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("dim", pa.int32()), ("whole", pa.binary())])

    def rows() -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                if vec_id is None or not values.is_valid or values.values.null_count:
                    continue
                x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    yield {"row": row, "vec_id": vec_id, "dim": len(x), "whole": _times_256(x).astype("<f8").tobytes()}

    yield from grouped(rows(), schema, 4096)


def _times_256(x: np.ndarray) -> np.ndarray:
    """floor(256 x), whole numbers in doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(x * 256)
    if not np.isfinite(out).all():
        raise ValueError("256 times a component is beyond the range of doubles")
    return out


def inner(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products of rows of whole numbers with one: in doubles or longs where they hold
    every partial sum, else with Python's numbers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    if most < 2**53:
        return (x @ q).astype(np.int64).tolist()
    if most < 2**62 and float(np.abs(x).max(initial=0)) < 2**62 and float(np.abs(q).max(initial=0)) < 2**62:
        return (x.astype(np.int64) @ q.astype(np.int64)).tolist()
    return [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, step, cells) of whole vectors: x lies in [low + cells step, low + (cells + 1) step]."""
    low = x.min(0, initial=np.inf) if len(x) else np.zeros(x.shape[1])
    # Halves keep the span of the largest doubles finite.
    step = np.maximum((x.max(0, initial=-np.inf) / 2 - low / 2) * (2 / STEPS) if len(x) else low, 1.0 / STEPS) * (1 + 1e-12)
    cells = np.clip(np.floor(x / step - low / step), 0, STEPS - 1).astype(np.uint8)
    return low, step, cells


def bounds(low: np.ndarray, step: np.ndarray, cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of queries (rows of ``q``) with the vectors in
    ``cells``, one row a query; nothing is known where doubles overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        mid = q @ (low + (cells + 0.5) * step).T
        most = np.abs(q) @ (np.abs(low) + STEPS * step)
        # Half a cell on each side, and what rounding may lose in sums and cells.
        half = np.abs(q) @ step / 2 + (len(low) + 16) * 2.0**-50 * most
        lower, upper = mid - half[:, None], mid + half[:, None]
    lost = ~np.isfinite(mid) | ~np.isfinite(half)[:, None]
    return np.where(lost, -np.inf, lower), np.where(lost, np.inf, upper)


BLOCK = "dim int, block long, rows binary, ids binary, same binary, low binary, step binary, data binary"
_BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((k, pa.binary()) for k in ("rows", "ids", "same", "low", "step", "data"))])


def _blocks(most: int, keep: int | None):
    """Pack vectors of one length into blocks: cells of the approximation file, of equal vectors
    the ``keep`` first only; or, for queries (None), the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: dict[int, list[tuple[int, int, bytes]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows, empty = sorted(held.pop(dim)), np.zeros(0)
            if keep:
                seen: Counter[bytes] = Counter()
                first = []
                for r in rows:
                    seen[r[2]] += 1
                    if seen[r[2]] <= keep:
                        first.append(r)
                rows = first
            x = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), dim)
            low, step, data = approximate(x) if keep else (empty, empty, x)
            return pa.RecordBatch.from_pylist([{
                "dim": dim, "block": number, "rows": np.array([r[1] for r in rows], "<i8").tobytes(), "ids": np.array([r[0] for r in rows], "<i8").tobytes(),
                "same": b"".join([xxhash.xxh3_128_digest(r[2]) for r in rows]) if keep else b"", "low": low.tobytes(), "step": step.tobytes(), "data": data.tobytes(),
            }], _BLOCK)

        for batch in batches:
            for row, vec_id, dim, whole in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "dim", "whole")), strict=True):
                own = held.setdefault(dim, [])
                own.append((vec_id, row, whole))
                if len(own) == most:
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return run


class Best:
    """What one block of queries has seen: the k largest lower bounds of each query, and the
    vectors whose upper bounds reach the smallest of these, of equal ones (told by 128-bit hashes)
    the k + 1 first."""

    def __init__(self, rows: np.ndarray, k: int) -> None:
        self.rows, self.k = rows, k
        self.least = np.full((len(rows), k), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, same: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        own = rows[None, :] == self.rows[:, None]
        lower = np.where(own, -np.inf, lower)
        every = np.concatenate([self.least, lower], 1)
        self.least = np.partition(every, every.shape[1] - self.k, 1)[:, -self.k :]
        q, v = np.nonzero((upper >= self.least.min(1)[:, None]) & ~own)
        self.found.append((q, rows[v], ids[v], same[v], lower[q, v], upper[q, v]))
        self.size += len(q)

    def close(self) -> tuple[np.ndarray, ...]:
        q, rows, ids, same, lower, upper = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((rows, ids, same[:, 0], same[:, 1], q))
        order = order[upper[order] >= self.least.min(1)[q[order]]]
        key = np.column_stack([q[order], same[order]])
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, np.int64)
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        stay = order[place <= self.k]
        return tuple(x[stay] for x in (self.rows[q], rows, ids, lower, upper))


FOUND = "query_row long, row long, vec_id long, lower double, upper double"


def _scan(k: int):
    """Pairs of a cell block and a query block: the vectors that may be among a query's best."""
    schema = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], Best] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for each in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in each.close()], schema=schema)
            best.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                b = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                dim, rows = b["dim"], np.frombuffer(b["rows"], "<i8")
                q_rows, cells = np.frombuffer(b["q_rows"], "<i8"), np.frombuffer(b["data"], np.uint8).reshape(len(rows), dim)
                if (dim, b["q_block"]) not in best:
                    best[dim, b["q_block"]] = Best(q_rows, k)
                q = np.frombuffer(b["q_data"], "<f8").reshape(len(q_rows), dim)
                best[dim, b["q_block"]].add(rows, np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["same"], "<i8").reshape(-1, 2), *bounds(np.frombuffer(b["low"]), np.frombuffer(b["step"]), cells, q))
                if sum(x.size for x in best.values()) > HELD:
                    yield from told()
        yield from told()
        trim()

    return run


def _read(k: int):
    """Rows sorted by query and falling upper bound: exact products, read until k are certain."""
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(rows: list[dict]) -> Iterator[dict]:
            found: list[tuple[int, int, int]] = []
            q = np.frombuffer(rows[0]["q_whole"], "<f8")
            for i in range(0, len(rows), READ):
                if len(found) == k and -found[-1][0] > rows[i]["upper"]:
                    break
                part = rows[i : i + READ]
                exact = inner(np.frombuffer(b"".join(r["whole"] for r in part), "<f8").reshape(len(part), len(q)), q)
                found = sorted([*found, *((-s, r["vec_id"], r["row"]) for s, r in zip(exact, part, strict=True))])[:k]
            for rank, (score, vec_id, _) in enumerate(found, 1):
                if not -(2**63) <= -score < 2**63:
                    raise ValueError(f"the inner product of vec_id {rows[0]['query_id']} and {vec_id} exceeds 64 bits")
                yield {"query_id": rows[0]["query_id"], "rank": rank, "vec_id": vec_id, "score": -score}

        def rows() -> Iterator[dict]:
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and row["query_row"] != held[0]["query_row"]:
                        yield from best(held)
                        held.clear()
                    held.append(row)
            if held:
                yield from best(held)

        yield from grouped(rows(), schema, 8192)

    return run


def _met(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Every block of queries with every block of cells of its length."""
    g, h = (max(1, -(-t.count() // GROUP)) for t in (cells, asked))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = cells.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(g))).withColumn("h", every(h))
    right = asked.withColumn("h", F.pmod(F.xxhash64("q_block"), F.lit(h))).withColumn("g", every(g))
    return left.join(right, ["dim", "g", "h"]).drop("g", "h", "block")


def candidates(whole: DataFrame, every: int, k: int) -> DataFrame:
    """(query_row, row, vec_id, upper): the vectors that the cells don't rule out for each query."""
    cells = saved(whole.mapInArrow(_blocks(CANDIDATES, k + 1), BLOCK), "va-file")
    asked = whole.where(F.col("vec_id") % every == 0).mapInArrow(_blocks(QUERIES, None), BLOCK)
    asked = saved(asked.select("dim", F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("data").alias("q_data")), "va-queries")
    # A stated set of queries against all rows: whole blocks meet, never single rows.
    found = saved(_met(asked, cells).mapInArrow(_scan(k), FOUND), "va-found")
    order = Window.partitionBy("query_row").orderBy(F.col("lower").desc())
    least = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    least = least.groupBy(F.col("query_row").alias("l_row")).agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("least"))
    near = found.join(least, F.col("query_row") == F.col("l_row")).where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    return near.select("query_row", "row", "vec_id", "upper")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors for each whose id ``every`` divides."""
    cut = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = saved(cut.mapInArrow(_whole, "row long, vec_id long, dim int, whole binary"), "va-vectors")
    near = candidates(whole, every, k)
    queries = whole.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("whole").alias("q_whole"))
    fetched = near.join(whole.select("row", "whole"), "row").join(queries, "query_row")
    dealt = fetched.repartition(partitions(vectors.sparkSession), "query_row").sortWithinPartitions("query_row", F.col("upper").desc(), "vec_id", "row")
    return dealt.mapInArrow(_read(k), "query_id long, rank int, vec_id long, score long")
