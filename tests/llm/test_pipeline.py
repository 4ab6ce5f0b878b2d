import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from netloom.llm import bpe, exact_dedup, quality, queries
from test_dedup import near_brute
from test_operators import mix_order

SF = "/root/testdata/sf0.001"


def test_names():
    registered = entry.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "conversations"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        got, want = (t[columns].sort_values(columns).reset_index(drop=True) for t in (got, want))
        assert got.equals(want.astype(got.dtypes.to_dict()))


def equal_texts(docs):
    groups = {}
    for r in docs.collect():
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in r["text"] or ""), []).append((r["doc_id"], r["text"]))
    return groups.values()


def test_stages_chain(spark):
    """Each stage against its operator's decisions, which the other tests hold against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        ids = Counter(r["doc_id"] for r in out.collect())
        if name == "quality":
            want = Counter(r["doc_id"] for r in quality.score(docs, quality.train(docs, labels)).where("predicted = 1").collect())
        elif name == "exact_dedup":
            want = Counter(r["doc_id"] for r in exact_dedup.classes(docs).where("kept").collect())
            assert want == Counter(max(i for i, t in group) for group in equal_texts(docs))
        elif name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            want = Counter(d for d, _, least in near_brute(rows, 80) if d == least)
        elif name == "mix":
            rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
            want = Counter(i for _, _, i in mix_order(rows))
            assert max(ids.values()) <= 2
        else:
            want = Counter(r["doc_id"] for r in docs.collect())
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, bpe.round_trip(docs, queries.MULTI, queries.PATTERN).collect()))
        assert ids == want, name
        if name != "tokens":
            assert out.columns == docs.columns
        kept[name], docs = ids, out
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good - set(kept["quality"])) <= 0.05 * len(good)
    run = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in run.collect()) == kept["tokens"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
