"""Secret scan: three fixed patterns, and random strings found by their token efficiency.

Text that a byte-pair vocabulary has seen packs several characters into a token; a random
string does not.  A long run of key characters whose characters per token fall below a
threshold is reported, after digests of known lengths, UUIDs and identifiers, whose longer parts
the vocabulary must pack well, are set aside.

Defined results: a null text is empty; spans count code points, the end exclusive; a random
string that overlaps a span of a fixed pattern is not reported again; every row gives a row, rows
that repeat included; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HINT = re.compile(r"(?ia)passw|secret|token|api_?key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words joined by signs, each with digits at one end at most.
IDENTIFIER = re.compile(r"[+/_=-]*(?:(?:[A-Za-z]+[0-9]*|[0-9]+[A-Za-z]*)(?:[+/_=-]+|$))*")
#: Parts of an identifier that are long enough to be random.
PART = re.compile(r"[A-Za-z0-9]{8,}")
#: Words of one case or capitalised; other languages' pack less well than the threshold (2 to 2.5),
#: random letters still worse (1.7; in 97 of 100 below this).
ONE_CASE, WORD_RATIO = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 2.05
#: Characters per token below which a run counts as random.
RATIO = 2.5


@functools.lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_known(run: str) -> bool:
    """Whether a run is a digest or a UUID."""
    return (len(run) in DIGESTS and HEXADECIMAL.fullmatch(run) is not None) or UUID.fullmatch(run) is not None


def is_identifier(run: str, encode, ratio: float = RATIO) -> bool:
    """Whether a run is words joined by signs, with no long part that packs badly."""
    least = lambda p: min(ratio, WORD_RATIO) if ONE_CASE.fullmatch(p) else ratio
    return IDENTIFIER.fullmatch(run) is not None and all(len(p) >= least(p) * len(encode(p)) for p in PART.findall(run))


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        start, end, run = m.start(), m.end(), m[0]
        if is_known(run) or any(s < end and start < e for s, _, e in base):
            continue
        if len(run) < ratio * len(encode(run)) and not is_identifier(run, encode, ratio):
            out.append((start, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every text."""
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:-1]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(raw.value, pattern)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                text = data.decode()
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base, encode, ratio))
                row = {"doc_id": doc_id, "base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(spans)}
                rows.append(row | {f"n_{name}": sum(k == i for _, k, _ in spans) for i, name in enumerate(KINDS)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
