"""Pieces against the library on whole texts, and texts rearranged for filling in the middle."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from netloom.llm import common, fim, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a ",
    "  a",
    "▁a ▁▁b▁",
    "two  spaces\n new\tline \x00 nul",
    "ünïcödé — 漢字 カタカナ 🎉🎉 \U0001f9ff",
    "<P> sentinel <0x0A> <s> </s> <unk>",
    "word " * 400_000,
    "a" * 300_000,
    "漢é🎉 x" * 50_000,
    "same text",
    "same text",
]
SCHEMA = "doc_id long, text string, block long, form string, output string, ids string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, 1, "k", "o", "clash") for i, t in enumerate(TEXTS)] + [(9, "same text", 1, "k", "o", "clash")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_round_trip(docs, library, monkeypatch):
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    for size in (common.BLOCK_BYTES, 64):
        monkeypatch.setattr(common, "BLOCK_BYTES", size)
        assert sorted(map(tuple, pieces.round_trip(docs, MODEL).collect()), key=str) == sorted(want, key=str)


def test_pieces_encode_then_decode(docs, library):
    some = docs.where("doc_id is not null and length(text) < 1000 and doc_id not in (9, 13, 14)")
    encoded = pieces.encode(some, MODEL)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL).collect()}
    for r in some.collect():
        assert ids[r["doc_id"]] == library.encode(r["text"]) and back[r["doc_id"]] == library.decode(ids[r["doc_id"]])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ▁\n.é漢🎉\x00T"), max_size=40))
def test_chunks_are_segmented_apart(text):
    own, whole = pieces.load(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [i for ids in own.encode(own.split(text.encode())) for i in ids] == whole.encode(text)


def test_crossing_models_raise(spark, docs, tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.pieces[5000].piece = "of▁the"
    (tmp_path / "crossing.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        pieces.encode(docs, str(tmp_path / "crossing.model"))


def brute_fim(doc_id, text):
    """The contract, by Python's own code points."""
    x = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_fim(spark, docs):
    more = spark.createDataFrame([(i, "<S<é漢" * (i % 7) + "<M" * (i % 3), 1, "k", "o", "c") for i in range(100, 300)], SCHEMA)
    every = docs.unionByName(more)
    want = [brute_fim(r["doc_id"], r["text"] or "") for r in every.select("doc_id", "text").collect()]
    got = fim.digests(every).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_restores(docs):
    rows = fim.restore(fim.transform(docs)).select("doc_id", "n", "output", "restored").collect()
    assert sorted((r["restored"] for r in rows)) == sorted(t or "" for t in [*TEXTS, "same text"])
    assert all(r["n"] == len(r["restored"]) for r in rows)
    plain = fim.transform(docs, rate=0).collect()
    assert {r["form"] for r in plain} == {"plain"}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.integers(0, 60))
def test_offsets(text, cut):
    own = fim.runs(text.encode())
    assert own.n == len(text)
    cut = min(cut, own.n)
    assert fim.offset(own, cut) == len(text[:cut].encode())
    assert (np.diff(own.widths) != 0).all()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<PSM>x"), max_size=30), st.integers(0, 10**6))
def test_any_text_comes_back(text, doc_id):
    row = fim.arranged(doc_id, text.encode(), rate=100, spm=50)
    assert fim.original(row["form"], row["output"]).decode() == text


def test_no_documents(docs):
    none = docs.where("false")
    assert pieces.round_trip(none, MODEL).count() == fim.digests(none).count() == 0
