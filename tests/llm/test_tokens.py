import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from netloom.llm import bpe, common, token_scan

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", "a", " ", "\n\n  x", "it's 1234 don't  \t\n", "ünïcödé — 漢字 カタカナ 🎉🎉", "word " * 3000, "a" * 5000, "same text", "same text", "tail  "]
SCHEMA = "doc_id long, text string, block long, kind string, ids string"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, 1, "k", "clash") for i, t in enumerate(TEXTS)] + [(9, "same text", 1, "k", "clash")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip(docs, encoding):
    got = bpe.round_trip(docs, VOCABULARY, PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode(docs, encoding):
    encoded = bpe.encode(docs.where("doc_id is not null and doc_id <> 9"), VOCABULARY, PATTERN)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, VOCABULARY).collect()}
    for i, text in enumerate(TEXTS):
        if i not in (3, 9):
            assert ids[i] == encoding.encode_ordinary(text or "") and back[i] == (text or "")


def test_pieces_are_those_of_the_library(encoding):
    split, (encode, table) = bpe.splitter(PATTERN), bpe._tables(open(VOCABULARY, "rb").read())
    for c in [*range(0x20, 0x3000, 7), *range(0xFF00, 0xFFEF), *range(0x1F300, 0x1F350)]:
        text = f"a{chr(c)}b  {chr(c)}1{chr(c)}{chr(c)}\n"
        assert [i for ids in encode(split(text.encode())) for i in ids] == encoding.encode_ordinary(text)


def test_many_blocks(docs, encoding, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 64)
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs, VOCABULARY, PATTERN).collect()}
    assert got[7] == len(encoding.encode_ordinary(TEXTS[7])) and len(got) == len(TEXTS)


def test_empty_tables(docs):
    assert bpe.round_trip(docs.where("false"), VOCABULARY, PATTERN).count() == 0
    assert token_scan.counts(docs.where("false"), VOCABULARY, PATTERN, 50256).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_counts(docs, encoding, block):
    got = token_scan.counts(docs, VOCABULARY, PATTERN, 50256, block).collect()
    want = [(r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("separator,kind", [(9, "<u2"), (70_000, "<u4")])
def test_scan_of_foreign_files(spark, tmp_path, separator, kind):
    rng, uris, want = np.random.default_rng(0), [], []
    for k in range(3):
        tokens = rng.integers(0, 9, 500)
        at = np.sort(rng.choice(500, 20, replace=False))
        tokens[at] = separator
        (tmp_path / f"{k}.bin").write_bytes(tokens.astype(kind).tobytes())
        uris.append((f"file://{tmp_path}/{k}.bin",))
        starts = [0, *(at + 1).tolist()]
        want += [(uris[-1][0], i, s, e - s, i < 20) for i, (s, e) in enumerate(zip(starts, [*at.tolist(), 500], strict=True)) if i < 20 or e > s]
    (tmp_path / "none.bin").write_bytes(b"")
    files = spark.createDataFrame([*uris, (f"file://{tmp_path}/none.bin",)], "file string")
    for block in (4, 40, 4096):
        assert sorted(map(tuple, token_scan.scan(files, separator, block).collect())) == sorted(want)


def test_prefix_scan_sorts_no_places(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([1, 9, 2, 9], "<u2").tobytes())
    plan = token_scan.scan(spark.createDataFrame([(f"file://{tmp_path}/x.bin",)], "file string"), 9)._jdf.queryExecution().optimizedPlan()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        scans += [node.output().mkString(" ")] if node.nodeName() == "Window" else []
    assert scans and not any("ends#" in out for out in scans)


def test_cut_token_raises(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within a token"):
        token_scan.scan(spark.createDataFrame([(f"file://{tmp_path}/x.bin",)], "file string"), 9).collect()
    with pytest.raises(ValueError):
        token_scan.scan(spark.createDataFrame([("x",)], "file string"), 9, 3)


def test_separator_of_the_vocabulary_raises(docs):
    with pytest.raises(ValueError, match="is a token"):
        token_scan.write(docs, VOCABULARY, PATTERN, 100)


def test_shared_folder_off_local_masters(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session, "x")
