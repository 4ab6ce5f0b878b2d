"""Fill-in-middle: texts rearranged so that a model sees what follows before what lies between.

A text is held as the maximal runs of its characters' classes with the number of units before each
run.  The classes are the widths of characters in UTF-8 and a unit is a code point, so a run of
equal widths turns a count of units into an offset by arithmetic: a cut is a binary search for its
run.  All work on a text is vectorised over its bytes; nothing is shuffled.

Where the cuts lie and which form a text takes follow from a digest of its id, so reruns agree.

Defined results: a null text is empty; an empty text, or one that holds a sentinel, stays plain; a
null id's digest is that of the seed alone; each row of the input, repeated ids included, gives one
row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import texts

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The class of a character by its first byte: its width in UTF-8, 0 for bytes that begin none.
WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


class Runs(NamedTuple):
    """Maximal runs of one class: units and bytes before each, the class, and the units of all."""

    units: np.ndarray
    starts: np.ndarray
    widths: np.ndarray
    n: int


def runs(text: bytes) -> Runs:
    classes = WIDTH[np.frombuffer(text, np.uint8)]
    classes = classes[classes > 0]
    n = len(classes)
    units = np.r_[0, np.flatnonzero(classes[1:] != classes[:-1]) + 1] if n else np.zeros(0, np.int64)
    widths = classes[units].astype(np.int64)
    lengths = np.diff(np.r_[units, n])
    return Runs(units, np.cumsum(lengths * widths) - lengths * widths, widths, n)


def offset(own: Runs, cut: int) -> int:
    """The byte at which the unit of this number begins; the end for the number of all units."""
    if not own.n:
        return 0
    run = int(np.searchsorted(own.units, cut, "right")) - 1
    return int(own.starts[run] + (cut - own.units[run]) * own.widths[run])


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))


def arranged(doc_id: int | None, text: bytes, seed: str = "1", rate: int = 90, spm: int = 20) -> dict:
    """One text's row.  ``rate`` in a hundred texts are rearranged, ``spm`` in a hundred of these
    with the suffix first."""
    own, (h1, h2, h3, h4) = runs(text), draws(seed, doc_id)
    row = {"doc_id": doc_id, "n": own.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return row
    low, high = sorted((h1 % (own.n + 1), h2 % (own.n + 1)))
    a, b = offset(own, low), offset(own, high)
    row |= {"prefix_chars": low, "middle_chars": high - low}
    if h4 % 100 < spm:
        return row | {"form": "spm", "output": b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))}
    return row | {"form": "psm", "output": b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))}


def original(form: str, output: bytes) -> bytes:
    """The text of an output.  Sentinels don't overlap themselves and the parts hold none, so each
    ends the part before it where it is found first."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at = output.index(second, 3)
    end = output.index(MIDDLE, at + 3)
    first, last, middle = output[3:at], output[at + 3 : end], output[end + 3 :]
    return first + middle + last if form == "psm" else last + middle + first


COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
#: Bytes of text in a batch of rows, unless one text has more.
BATCH = 4 << 20


def transform(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                rows.append(arranged(doc_id, text, seed, rate, spm))
                size += len(text)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def restore(outputs: DataFrame) -> DataFrame:
    """Adds ``restored``, the exact text rebuilt from ``form`` and ``output``."""
    schema = outputs.withColumn("restored", F.lit("")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            data = [original(form, output) for form, output in zip(forms, texts(batch, "output"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Every document rearranged and rebuilt, with digests in place of the texts."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(transform(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
