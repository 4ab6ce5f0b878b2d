"""SentencePiece: every distinct marked word of the corpus is segmented once (``distinct``).

The library's normaliser turns spaces into markers and may put one in front.  Where no piece of a
model holds a marker after another character, no merge crosses the front of a run of markers: a
text falls apart into chunks, a run of markers and what follows it, whose segmentations don't
depend on each other.  Distinct chunks are segmented once, by the same model with its normaliser
turned off, and documents are put together by position; ids are decoded a document at a time,
by the library, because its decoder treats the front of a text apart.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty one; each
row of the input, repeated ids and null ids included, gives one row; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netloom.llm.distinct import assembled

#: The library's marker for a space.
MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


class Model(NamedTuple):
    split: Callable[[bytes], list[bytes]]
    encode: Callable[[list[bytes]], list[list[int]]]
    decode: Callable[[np.ndarray], str]
    decimals: list[str]


def check(raw: bytes) -> None:
    """Raise where chunks of a model can't be segmented apart."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    pieces = {p.piece for p in model.pieces}
    if model.trainer_spec.treat_whitespace_as_suffix or any(MARKER in p.lstrip(MARKER) for p in pieces):
        raise ValueError("pieces of this model cross white-space markers")
    if MARKER not in pieces and not model.trainer_spec.byte_fallback:
        raise ValueError("this model joins unknown characters across white-space markers")


@functools.lru_cache(maxsize=2)
def load(raw: bytes) -> Model:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    whole = SentencePieceProcessor(model_proto=raw)
    plain = sentencepiece_model_pb2.ModelProto()
    plain.ParseFromString(raw)
    # Chunks are normalised already.
    plain.normalizer_spec.add_dummy_prefix = plain.normalizer_spec.remove_extra_whitespaces = False
    plain.normalizer_spec.precompiled_charsmap = b""
    bare = SentencePieceProcessor(model_proto=plain.SerializeToString())

    def split(text: bytes) -> list[bytes]:
        chunks = whole.normalize(text.decode())
        if 2 * MARKER in chunks or not chunks.startswith(MARKER):
            return [chunk.encode() for chunk in CHUNK.findall(chunks)]
        front = MARKER.encode()
        return [front + word for word in chunks.encode()[len(front) :].split(front)]

    return Model(
        split,
        lambda chunks: bare.encode([chunk.decode() for chunk in chunks], num_threads=1),
        lambda ids: whole.decode(ids) if len(ids) else "",
        [str(i) for i in range(whole.get_piece_size())],
    )


def _shared(docs: DataFrame, model: str):
    """The model, broadcast: a file of fixed size (half a megabyte)."""
    with open(model, "rb") as f:
        raw = f.read()
    check(raw)
    return docs.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id long, ids array<int>): the ids of each text, without begin or end."""
    shared = _shared(docs, model)
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    own = lambda doc_id, ids: {"doc_id": doc_id, "ids": ids.tolist()}
    return assembled(docs, lambda text: load(shared.value).split(text), lambda chunks: load(shared.value).encode(chunks), own, "doc_id long, ids array<int>", arrow, "pieces")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id long, text string): each row's ids as text."""
    shared = _shared(encoded, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(shared.value)
        for batch in batches:
            data = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text and decode its ids."""
    shared = _shared(docs, model)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(doc_id: int | None, ids: np.ndarray) -> dict:
        own = load(shared.value)
        text, listed = own.decode(ids), ",".join(map(own.decimals.__getitem__, ids.tolist()))
        return {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return assembled(docs, lambda text: load(shared.value).split(text), lambda chunks: load(shared.value).encode(chunks), digests, schema, arrow, "pieces")
