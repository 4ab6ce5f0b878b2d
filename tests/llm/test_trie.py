"""The trie of conversations against a brute-force one."""

import hashlib
import random
import zlib

import pytest

from netloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, front binary"


def sequences(rows, rebuild):
    """Each conversation's turns; the order of equal turn numbers is that of their digests."""
    own = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv_id, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows, rebuild=True):
    members, ends = {}, {}
    for c, turns in sequences(rows, rebuild).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, spared = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        spared[k] = sum(spared[x] for x in below) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], spared[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    )


def got(spark, rows, rebuild=True, most=trie.MOST):
    own = trie.ordered(spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA).repartition(3))
    return sorted(map(tuple, trie.nodes(trie.rebuilt(own) if rebuild else own, most).collect()))


def some(seed, convs=60, words=3, most=6):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(("user", None)), rng.choice(["é" * 3, "b", None, "ccc"][:words])) for c in range(convs) for t in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [trie.MOST, 40, 1])
@pytest.mark.parametrize("rebuild", [True, False])
def test_small_tables(spark, most, rebuild):
    rows = some(most) + [(100, None, None, None), (100, 0, "user", "x"), (100, 0, "user", "x"), (100, 0, "user", "a"), (None, 0, "user", "lost"), (7003, 5, "user", "no head"), (-7, 0, "user", "b")]
    if rebuild:
        rows = [r for r in rows if r[0] != -7]
    assert got(spark, rows, rebuild, most) == brute(rows, rebuild)


def test_turnless_conversations(spark):
    lost = next(c for c in range(1, 10**4) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    rows = [(lost, 0, "user", "x"), (lost, 1, "user", "y")]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 1
    assert got(spark, rows + some(5, 10)) == brute(rows + some(5, 10))


def test_hot_starts_are_dealt_anew(spark):
    """A common start of 40 turns, copies, a conversation that ends within the start, a long text."""
    start = [(t, "user", f"turn {t}") for t in range(40)]
    rows = [(c, t, r, x) for c in range(60) for t, r, x in [*start, (40, "user", f"{c % 20}"), (41, "user", f"{c}")]]
    rows += [(60, t, r, x) for t, r, x in start[:7]] + [(61, t, r, x) for t, r, x in start] + [(62, 0, "user", "z" * 2_000_000)]
    rows += [(c, t, r, x) for c in (63, 64, 65) for t, r, x in [*start, (40, "user", "copy")]]
    for most in (100, 1000):
        assert got(spark, rows, False, most) == brute(rows, False)


def test_ids_of_copies_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE", 4)
    rows = [(c, 0, "user", "same") for c in [*range(-9, 30), 1000, 5]]
    rows = list(dict.fromkeys(rows))
    assert got(spark, rows, False) == brute(rows, False)


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.of_rebuilt(none).count() == 0
    assert trie.of_rebuilt(spark.createDataFrame([(None, 0, "user", "x", 1, b"x")], SCHEMA)).count() == 0
