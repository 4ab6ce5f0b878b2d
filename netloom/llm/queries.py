"""The registered query of each operator: its whole table, production parameters, full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, exact_dedup, fim, mixing, near_dedup, pieces, ppm, quality, secrets, token_scan, trie, vafile, warc
from netloom.session import ship

#: Parameters: the vocabularies and the free id that ends a document.
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENGLISH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN, END_OF_DOCUMENT = public_tokenizers.PATTERN, 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files by their separators."""
    return token_scan.counts(_table(spark, sf_dir, "documents"), MULTI, PATTERN, END_OF_DOCUMENT)


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text under PPM and a word model."""
    return ppm.score(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), MULTI, PATTERN)


def op4_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dedup.groups(_table(spark, sf_dir, "documents"), near_dedup.PERCENT)


def op5_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every text."""
    return secrets.scan(_table(spark, sf_dir, "documents"), ENGLISH, PATTERN)


def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document."""
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


def op7_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix at target weights takes of every document."""
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return vafile.top_k(_table(spark, sf_dir, "embeddings"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded into pieces and decoded."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), PIECES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What starts the rebuilt conversations share."""
    return trie.of_rebuilt(_table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text rearranged for filling in the middle, and rebuilt."""
    return fim.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_separator_scan,
        op2_ppm,
        op3_bpe,
        op4_odd_sketches,
        op5_token_efficiency,
        op6_radix_dedup,
        op7_low_discrepancy_mix,
        op8_warc,
        op9_boosted_quality,
        op10_va_file,
        op11_sentencepiece,
        op12_prefix_trie,
        op13_fill_in_middle,
    )
}

_UPPER = exact_dedup.UPPER
#: DuckDB SQL where it can express the operator.
ORACLE_SQL = {
    "op6_radix_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op7_low_discrepancy_mix": mixing.SQL,
    "op10_va_file": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op12_prefix_trie": trie.SQL,
    "op13_fill_in_middle": fim.SQL,
}
