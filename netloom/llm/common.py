"""Helpers the operators share: the shared folder, packed columns, word splitting.

Files that one task writes and another reads go to the folder named by
``spark.checkpoint.dir`` only, because executors share no other folder.
"""

from __future__ import annotations

import atexit
import ctypes
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A byte that UTF-8 never contains, so it can separate packed strings.
SEP = b"\xff"
#: Bytes of text that one block of documents holds (the last document may run over).
BLOCK_BYTES = 8 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below ``spark.checkpoint.dir``; removed when the driver exits."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer, if the session still runs."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and its folder with it
        pass


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file of the shared folder from a task: whole or not at all."""
    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes:
    store, path = _place(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def trim() -> None:
    """Give memory back at the end of a task: idle Python workers would keep it for good."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def grouped(rows: Iterable[dict], schema: pa.Schema, most: int = 128) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of ``most`` rows."""
    group: list[dict] = []
    for row in rows:
        group.append(row)
        if len(group) == most:
            yield pa.RecordBatch.from_pylist(group, schema)
            group = []
    if group:
        yield pa.RecordBatch.from_pylist(group, schema)
    group.clear()
    trim()


#: Bits that ``marked`` looks rows up in: a fixed size.
FILTER_LOG = 24


def marked(df: DataFrame, value: Column, keys: DataFrame, key: Column) -> DataFrame:
    """Adds ``maybe``: false only where ``value`` (a hash) is among no ``key`` of ``keys``.

    The keys' bits, at most 2^FILTER_LOG / 64 rows of two numbers whatever the input, go to every
    task, so rows that cannot match are told apart before any shuffle.
    """
    low = lambda c: c.bitwiseAND(F.lit((1 << FILTER_LOG) - 1))
    bits = keys.select(low(key).alias("h")).groupBy(F.expr("h div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("_bits"))
    met = df.withColumn("_h", low(value)).join(F.broadcast(bits), F.expr("_h div 64") == F.col("_word"), "left")
    return met.withColumn("maybe", F.expr("coalesce(getbit(_bits, cast(_h % 64 as int)) = 1, false)")).drop("_h", "_word", "_bits")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which it sizes for the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: int | None, mod: int) -> bool:
    """Whether crc32 of the id as text leaves 1; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == 1


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, one value in memory at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    for value in col:
        yield value.as_py() or b""


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def swell(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    return squeeze(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(swell(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_doubles(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values, "<f8").tobytes())


def unpack_doubles(data: bytes) -> np.ndarray:
    return np.frombuffer(swell(data), "<f8")


def pack_words(words: list[bytes]) -> bytes:
    """A list of byte strings free of 0xFF; the empty list differs from one empty string."""
    return squeeze(SEP.join(words) + SEP if words else b"")


def unpack_words(data: bytes) -> list[bytes]:
    return swell(data).split(SEP)[:-1]


class Ids(dict):
    """Numbers strings in the order in which they first appear."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Dealt(NamedTuple):
    """A block's documents: (id, flag) of each, all word numbers by position, words per document;
    the block's distinct words by number where they are kept, and how many they are."""

    docs: list[tuple[int | None, bool]]
    flat: np.ndarray
    lens: np.ndarray
    words: list[bytes]
    kinds: int

    def check(self, answered: int) -> None:
        """A task that runs again must find its rows as before; if it hasn't, some answers are missing."""
        if answered != self.kinds:
            raise RuntimeError("the input changed while it was read; write it to a table first")


class Block:
    """Documents as arrays of local word numbers, and the block's distinct words.

    Words are numbered by falling frequency, so the arrays compress well.  ``flag``
    marks documents whose words are counted apart (those a model learns from).
    """

    def __init__(self) -> None:
        self.ids = Ids()
        self.docs: list[tuple[int | None, bool]] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, flag: bool, words: Iterable[bytes], count: int, size: int) -> None:
        self.docs.append((doc_id, flag))
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.uint32, count))
        self.size += size

    def rows(self, number: int, buckets: int, folder: str, also: Also | None = None) -> Iterator[dict]:
        """Write the documents to the shared folder; a row for each bucket of distinct words."""
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        lens = np.array([len(p) for p in self.parts], np.uint32)
        self.parts.clear()
        total = np.bincount(flat, minlength=len(self.ids))
        flagged = np.repeat(np.array([f for _, f in self.docs], bool), lens)
        learnt = np.bincount(flat[flagged], minlength=len(self.ids))
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        every, words = list(self.ids), []
        if also:
            words = [every[i] for i in order.tolist()]
        dealt = Dealt(self.docs, rank[flat], lens, words, len(every))
        data = pickle.dumps((self.docs, pack_ints(dealt.flat), pack_ints(lens), pack_words(words), len(every)))
        # The number tells blocks with other documents apart, should a task find others when it runs again.
        block = number << 23 | xxhash.xxh3_64_intdigest(data) >> 41
        put_file(f"{folder}/{block}", data)
        deal: dict[int, list[bytes]] = {} if self.ids else {0: []}
        for word in sorted(every):
            deal.setdefault(zlib.crc32(word) % buckets, []).append(word)
        for bucket, own_words in deal.items():
            own = np.fromiter(map(self.ids.__getitem__, own_words), np.int64, len(own_words))
            yield {"block": block, "bucket": bucket, "a": pack_words(own_words), "b": pack_ints(rank[own]), "c": pack_ints(learnt[own])}
        if also:
            yield from also(block, dealt, learnt[order])


def read_block(folder: str, block: int) -> Dealt:
    docs, flat, lens, words, kinds = pickle.loads(get_file(f"{folder}/{block}"))
    return Dealt(docs, unpack_ints(flat), unpack_ints(lens), unpack_words(words), kinds)


#: What makes more rows of a block: its number, its documents and its words' counts in flagged ones.
Also = Callable[[int, Dealt, np.ndarray], Iterator[dict]]
BLOCK_SCHEMA = "block long, bucket int, a binary, b binary, c binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def blocks(docs: DataFrame, split: Callable[[bytes], list[bytes]], mod: int, buckets: int, name: str, also: Also | None = None) -> tuple[DataFrame, str]:
    """Cut documents into blocks: (rows of distinct words by bucket, folder with the documents).

    One pass reads the texts.  It leaves each block's documents, as word numbers by position,
    in a file of the shared folder, and returns the block's distinct words in packed rows
    (a: words, b: their local numbers, c: occurrences in flagged documents).  A block's number
    joins the partition's number, a running one and bits of its content, so a task that runs
    again writes the same file; every block gives at least one row.  ``also`` may add rows, and
    then the file keeps the words too.
    """
    folder = shared_dir(docs.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 16, Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                words = split(text)
                block.add(doc_id, not held_out(doc_id, mod), words, len(words), len(text) + 16)
                if block.size >= BLOCK_BYTES:
                    yield from grouped(block.rows(number, buckets, folder, also), BLOCK_ARROW)
                    number, block = number + 1, Block()
        if block.docs:
            yield from grouped(block.rows(number, buckets, folder, also), BLOCK_ARROW)
        block = None
        trim()

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, BLOCK_SCHEMA), folder
