import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netloom.llm import common, ppm

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows):
    """Scores straight from the definition: counts of every context of the running text, exclusion
    step by step."""
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    text = [(i, WORDS.findall((t or "").encode().lower())) for i, t in rows]
    count, context = Counter(), defaultdict(Counter)
    coded = lambda words: [32, *b"".join(w + b" " for w in words), 256]
    for i, words in text:
        if train(i):
            count.update([*words, None])
            full = coded(words)
            for j in range(1, len(full)):
                for o in range(min(j, ppm.ORDER) + 1):
                    context[tuple(full[j - o : j])][full[j]] += 1
    n, v = sum(count.values()), len(count)

    def cost(words):
        full, total = coded(words), 0.0
        for j in range(1, len(full)):
            gone, found = set(), False
            for o in range(min(j, ppm.ORDER), -1, -1):
                left = {s: k for s, k in context.get(tuple(full[j - o : j]), {}).items() if s not in gone}
                if not left:
                    continue
                weight = sum(left.values()) + len(left)
                if full[j] in left:
                    total, found = total + math.log10(left[full[j]] / weight), True
                    break
                total += math.log10(len(left) / weight)
                gone |= set(left)
            if not found:
                total -= math.log10(257 - len(gone))
        return total

    out = []
    for i, words in text:
        tokens = [*words, None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, not train(i), len(tokens), sum(count[w] > 0 for w in tokens), n, base, cost(words)))
    return out


def check(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def documents(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["The", "of", "ab", "ing", "ß", "漢", "x1", "QU", "\t", "\n", " ", "  "]
    return [(i, "".join(rng.choice(parts, rng.integers(0, 40)))) for i in range(n)]


def test_against_brute_force(spark):
    rows = [*documents(0, 60), (100, None), (101, ""), (None, "the end of it"), (102, "zzz unseen ☃"), (103, "ab " * 500), (103, "ab " * 500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held_out string").repartition(4)
    got = ppm.score(df).collect()
    check(got, brute(rows))
    assert all(r["score"] < 0 for r in got)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 200)
    rows = documents(1, 40)
    check(ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def test_nothing_to_learn(spark):
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "a bc") for i in out]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert got[0]["score"] == pytest.approx(-6 * math.log10(257))
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    texts = [[b"ab", b"abc"], [b"b", b"cab", b"ab"], [b"a"]]
    vocabulary = sorted({w for t in texts for w in t})
    flat = np.array([vocabulary.index(w) for t in texts for w in t], np.uint32)
    coded, sums = ppm.Coded(vocabulary, flat, np.array([2, 3, 1], np.uint32)), ppm.Sums()
    counts = np.bincount(flat)
    for keys, part in coded.own():
        sums.add(*ppm._summed(keys, counts[part]))
    for _, _, _, keys in coded.first():
        sums.add(*ppm._counted(keys, np.ones(len(keys), np.int64)))
    keys, counts = sums.close()
    one, n = ppm._summed(ppm._key(1, (keys >> 9) & 255, keys & 511), counts)
    none, m = ppm._summed(ppm._key(0, one, one & 511), n)
    short, (keys, counts) = ppm.Short(np.r_[one, none], np.r_[n, m]), ppm._nested(keys, counts)
    for context, reach in ((b" ab", 3), (b" ", 1), (b" zz", 3), (b" c", 2), (b"b ab ", 5)):
        window = sum(b << (8 * k) for k, b in enumerate(reversed(context)))
        asked = np.array([ppm._key(reach, np.int64(window), np.int64(s)) for s in range(257)]).ravel()
        assert (10 ** ppm.costs(keys, counts, asked, short)).sum() == pytest.approx(1)


@pytest.mark.parametrize("block,chunk", [(8 << 20, 1 << 20), (200, 1 << 20), (8 << 20, 50)])
def test_blocks_and_chunks(spark, monkeypatch, block, chunk):
    """Contexts run on across words, whatever the blocks and the pieces that numpy handles."""
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    monkeypatch.setattr(ppm, "SUMS", chunk)
    rows = [*documents(2, 60), (100, None), (101, ""), (None, "the end of it"), (102, "zzz unseen ☃"), (103, "a b c " * 100), (104, "x" * 300), (105, "nul \0 byte")]
    check(ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), brute(rows))


def test_hot_contexts_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 100)
    monkeypatch.setattr(ppm, "ASKED", 3)
    rows = documents(3, 60)
    check(ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), brute(rows))


def test_a_very_long_word(spark):
    rng = np.random.default_rng(4)
    rows = [*documents(4, 20), (200, "".join(rng.choice(list("abcd"), 1 << 20)))]
    got = {r["doc_id"]: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx({i: r[6] for i, r in want.items()}, rel=1e-9)


def test_a_word_costs_less_after_one_it_followed(spark):
    a, b = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "ring around the rosy") for i in range(20)] + [(a, "around the"), (b, "the around")]
    got = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[a] > got[b]


def test_query_beats_the_word_model(spark):
    """Held-out texts, from a table that is large enough to learn spelling from."""
    from netloom.llm import queries

    got = queries.op2_ppm(spark, "/root/testdata/sf0.1").where("held_out").groupBy().sum("score", "base_score").first()
    assert got["sum(score)"] > got["sum(base_score)"]
