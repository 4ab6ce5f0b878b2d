"""Token counts of documents in flat, unindexed token files.

A token file holds nothing but fixed-width little-endian ids, each document followed by the
end-of-document id.  Nothing says where documents lie, so the scan cuts every file into blocks,
finds the separators of a block with one vectorised comparison, and stitches documents that
cross blocks by a prefix scan over the blocks' summaries: the number of separators so far and
the end of the last one.  Blocks of one file spread over the cluster; only positions of
separators leave the executors.

Defined results: an empty or null text is a document of 0 tokens; tokens after a file's last
separator make a document with ``ended`` false; an empty file has no documents; null and
repeated ids each keep their row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import _place, grouped, partitions, saved, shared_dir, texts

BLOCK_BYTES = 4 << 20


def _width(separator: int) -> np.dtype:
    return np.dtype("<u2") if separator < 1 << 16 else np.dtype("<u4")


def write(docs: DataFrame, vocabulary: str, pattern: str, separator: int) -> DataFrame:
    """Write each partition's texts as a token file; returns (file, ordinal, doc_id), the order of
    documents in the files.  File names are the attempt's own, and only committed rows name them."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-files")
    with open(vocabulary, "rb") as f:
        data = f.read()
    if any(int(line.split()[1]) == separator for line in data.splitlines()):
        raise ValueError(f"the separator {separator} is a token of the vocabulary")
    raw = spark.sparkContext.broadcast(data)
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        kind, end, uri, ordinal = _width(separator), np.array([separator], _width(separator)).tobytes(), f"{folder}/{uuid.uuid4().hex}.bin", 0
        store, path = _place(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            for batch in batches:
                for text in texts(batch):
                    out.write(np.array(encode(text.decode()), kind).tobytes() + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], schema=schema)
                ordinal += n

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(cut.mapInArrow(run, "file string, ordinal long, doc_id long"), "token-order")


def scan(files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in the files of column ``file``.

    ``start`` counts tokens from the file's beginning; ``block_bytes`` is a multiple of the width.
    """
    kind, spark = _width(separator), files.sparkSession
    if block_bytes % kind.itemsize:
        raise ValueError("a block must hold whole tokens")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    store, path = _place(uri)
                    size = store.get_file_info(path).size
                    for i in range(-(-size // block_bytes)):
                        yield {"file": uri, "block": i, "bytes": min(block_bytes, size - i * block_bytes)}

        yield from grouped(rows(), pa.schema([("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64())]), 4096)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    store, path = _place(row["file"])
                    with store.open_input_file(path) as f:
                        data = f.read_at(row["bytes"], row["block"] * block_bytes)
                    if len(data) % kind.itemsize:
                        raise ValueError(f"{row['file']} ends within a token")
                    first = row["block"] * (block_bytes // kind.itemsize)
                    tokens = np.frombuffer(data, kind)
                    yield {"file": row["file"], "block": row["block"], "upto": first + len(tokens), "ends": (np.flatnonzero(tokens == separator) + first).tolist()}

        yield from grouped(rows(), pa.schema([("file", pa.string()), ("block", pa.int64()), ("upto", pa.int64()), ("ends", pa.list_(pa.int64()))]), 8)

    found = (
        files.select("file").distinct().repartition(partitions(spark), "file")
        .mapInArrow(listed, "file string, block long, bytes long")
        .repartition(partitions(spark), "file", "block")
        .mapInArrow(search, "file string, block long, upto long, ends array<long>")
    )
    # The prefix scan runs over three numbers a block; the separators' places stay where they are.
    found = saved(found, "token-ends")
    seps = F.size("ends")
    short = found.select("file", "block", seps.alias("seps"), F.when(seps > 0, F.element_at("ends", -1) + 1).alias("last_end"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = short.select(
        "file", "block",
        F.coalesce(F.sum("seps").over(before), F.lit(0)).cast("long").alias("ordinal"),
        F.coalesce(F.max("last_end").over(before), F.lit(0)).alias("begun"),
        F.lead("block").over(order).isNull().alias("last"),
    )
    stitched = found.join(scanned, ["file", "block"])
    # Each document's start is the last separator before it, in this block or in an earlier one;
    # a file's last block adds the document that no separator ends.
    ends = F.when(F.col("last"), F.concat("ends", F.array(F.col("upto")))).otherwise(F.col("ends"))
    starts = F.concat(F.array(F.col("begun")), F.transform("ends", lambda e: e + 1))
    each = stitched.select("file", "ordinal", "last", F.size("ends").alias("seps"), F.posexplode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("i", "doc"))
    each = each.where(F.col("doc.end").isNotNull()).select(
        "file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("doc.start").alias("start"),
        (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"), (F.col("i") < F.col("seps")).alias("ended"),
    )
    return each.where("ended or n_tokens > 0")


def counts(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens): write the documents as token files, then count them by the scan alone."""
    order = write(docs, vocabulary, pattern, separator)
    # Its files are small, its rows as many as documents: too many to broadcast.
    return scan(order, separator, block_bytes).join(order.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
