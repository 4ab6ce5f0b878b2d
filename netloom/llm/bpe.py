"""Byte-level BPE: every distinct pre-token of the corpus is encoded once (``distinct``), documents
are put together by position and decoded by looking each of their ids up in the token-byte table.

Defined results: a null text is empty; an empty text has no ids and decodes to nothing; each
row of the input, repeated ids and null ids included, gives one row; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.llm.distinct import assembled


@functools.lru_cache(maxsize=2)
def _tables(raw: bytes) -> tuple[Callable[[list[bytes]], list[list[int]]], list[bytes]]:
    """The piece encoder and the token-byte table of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    # Pieces arrive already split, so the pattern takes each whole.
    encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return lambda pieces: [encoding.encode_ordinary(piece.decode()) for piece in pieces], table


@functools.lru_cache(maxsize=2)
def _decimals(size: int) -> list[bytes]:
    return [b"%d" % i for i in range(size)]


@functools.lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[bytes], list[bytes]]:
    import regex

    find = regex.compile(pattern).findall
    return lambda text: [piece.encode() for piece in find(text.decode())]


def _shared(docs: DataFrame, vocabulary: str):
    """The rank file, broadcast: a vocabulary is a file of fixed size (well under 2 MB)."""
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id long, ids array<int>): the ids of each text, without special tokens."""
    shared = _shared(docs, vocabulary)
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    own = lambda doc_id, ids: {"doc_id": doc_id, "ids": ids.tolist()}
    return assembled(docs, splitter(pattern), lambda pieces: _tables(shared.value)[0](pieces), own, "doc_id long, ids array<int>", arrow, "bpe")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id long, bytes binary): each row's ids looked up in the token-byte table and joined."""
    shared = _shared(encoded, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = _tables(shared.value)
        for batch in batches:
            data = [b"".join([table[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text and decode its ids."""
    shared = _shared(docs, vocabulary)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(doc_id: int | None, ids: np.ndarray) -> dict:
        (_, table), ids = _tables(shared.value), ids.tolist()
        listed = b",".join(map(_decimals(len(table)).__getitem__, ids))
        decoded = b"".join(map(table.__getitem__, ids))
        return {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return assembled(docs, splitter(pattern), lambda pieces: _tables(shared.value)[0](pieces), digests, schema, arrow, "bpe")
