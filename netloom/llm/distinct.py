"""The distinct-word shuffle: every distinct word of the corpus is encoded once.

A pass over the text splits it into words and leaves, for each block of documents, the words'
numbers by position (a file of the shared folder) and the block's distinct words, dealt into
buckets by hash.  A bucket meets all blocks' distinct words, encodes each of them once and answers
each block; a block joins the answers and puts its documents' ids together by position.  A word
crosses the network once per block that holds it, not once per occurrence, so frequent words
make no hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.llm.common import blocks, grouped, pack_ints, partitions, read_block, trim, unpack_ints, unpack_words

ANSWER = pa.schema([("block", pa.int64()), ("lids", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])


def _answers(encode: Callable[[list[bytes]], list[list[int]]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by bucket: encode a bucket's distinct words once, answer every block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            bucket, known = None, {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["bucket"] != bucket:
                        bucket, known = row["bucket"], {}
                    words = unpack_words(row["a"])
                    new = [word for word in words if word not in known]
                    known.update(zip(new, encode(new), strict=True))
                    found = [known[word] for word in words]
                    counts = np.fromiter(map(len, found), np.uint32, len(found))
                    ids = np.fromiter((i for own in found for i in own), np.uint32, int(counts.sum()))
                    yield {"block": row["block"], "lids": row["b"], "counts": pack_ints(counts), "ids": pack_ints(ids)}

        yield from grouped(rows(), ANSWER)

    return run


def assembled(
    docs: DataFrame,
    split: Callable[[bytes], list[bytes]],
    encode: Callable[[list[bytes]], list[list[int]]],
    row: Callable[[int | None, np.ndarray], dict],
    schema: str,
    arrow: pa.Schema,
    name: str,
) -> DataFrame:
    """One row per document, ``row(doc_id, ids)``: ``split`` cuts a text into words, ``encode`` gives
    words' ids, and a document's ids are its words' by position.  All three run in tasks."""
    spark = docs.sparkSession
    buckets = max(64, 2 * partitions(spark))
    words, folder = blocks(docs, split, -1, buckets, name)
    answers = (
        words.select("block", "bucket", "a", "b")
        .repartition(max(partitions(spark), 12), "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: _answers(encode)(batches), "block long, lids binary, counts binary, ids binary")
    )

    def assemble(answers: pa.Table) -> pa.Table:
        dealt = read_block(folder, answers.column("block")[0].as_py())
        # A word's ids by its number: where they start in all answers' ids, and how many they are.
        starts, lens = np.zeros(dealt.kinds, np.int64), np.zeros(dealt.kinds, np.int64)
        parts, told, at = [np.zeros(0, np.uint32)], 0, 0
        for answer in answers.to_pylist():
            lids, counts, ids = (unpack_ints(answer[k]) for k in ("lids", "counts", "ids"))
            starts[lids], lens[lids] = at + np.cumsum(counts, dtype=np.int64) - counts, counts
            parts.append(ids)
            told, at = told + len(lids), at + len(ids)
        dealt.check(told)
        own, start, out = np.concatenate(parts).astype(np.int32), 0, []
        for (doc_id, _), n in zip(dealt.docs, dealt.lens.tolist(), strict=True):
            words = dealt.flat[start : start + n]
            counts = lens[words]
            before = np.cumsum(counts) - counts
            out.append(row(doc_id, own[np.arange(counts.sum()) + np.repeat(starts[words] - before, counts)]))
            start += n
        del own, dealt, parts
        trim()
        return pa.Table.from_pylist(out, arrow)

    return answers.groupBy("block").applyInArrow(assemble, schema)
