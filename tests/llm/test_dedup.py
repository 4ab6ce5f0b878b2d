import re

import numpy as np
import pytest

from netloom.llm import common, exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, kept boolean, keep_id long, lang string"


def exact_brute(rows):
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays))
    return sorted(out, key=str)


def exact_rows():
    long = "Words and words. " * 3000
    rows = [(1, "A"), (2, "a"), (3, "ä"), (4, "Ä"), (5, None), (6, ""), (7, long), (8, long.upper()), (9, long + "x"), (10, long + "y"), (11, long[:-1] + "!"), (None, "a"), (None, "n"), (None, "n")]
    rows += [(20 + i, "same head " * 8 + str(i % 3)) for i in range(9)] + [(2, "a"), (2, "other")]
    return rows


def test_exact_against_brute_force(spark):
    rows = exact_rows()
    df = spark.createDataFrame([(*r, True, 1, "en") for r in rows], SCHEMA).repartition(4)
    got = exact_dedup.classes(df).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str) == exact_brute(rows)
    import hashlib

    assert {r["text_sha256"] for r in got if r["doc_id"] in (1, 2)} >= {hashlib.sha256(b"a").hexdigest()}


def test_exact_kept_rows(spark):
    rows = exact_rows()
    df = spark.createDataFrame([(*r, True, 1, "en") for r in rows], SCHEMA)
    out = exact_dedup.kept(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((r[0] for r in exact_brute(rows) if r[3]), key=str)
    assert exact_dedup.kept(df.where("false")).count() == 0 and exact_dedup.classes(df.where("false")).count() == 0


def near_brute(rows, percent=85, order="sorted"):
    word = re.compile(rb"[^\x20\x09-\x0d]+")
    sets = []
    for _, t in rows:
        w = word.findall((t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    if order == "groups":
        return [find(i) if sets[i] else None for i in range(len(rows))], least
    return sorted(out, key=str)


def near_rows(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows, n = [], 0
    for size, edits in ((200, 30), (60, 20), (400, 12), (12, 6)):
        base = [word() for _ in range(size)]
        for e in range(edits):
            own = list(base)
            for _ in range(e % 7):
                own[rng.integers(0, len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(n + i, passage + " " + " ".join(word() for _ in range(40 + i))) for i in range(25)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (905, "a b c d e"), (906, "A B C D E"), (907, "x " * 3000), (908, "x " * 10), (909, passage * 30)]
    return rows + [(0, rows[0][1]), (None, rows[3][1]), (None, "alone here with five words")]


@pytest.mark.parametrize("chunk", [2048, 8])
def test_near_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = near_rows(chunk)
    df = spark.createDataFrame([(*r, True, 1, "en") for r in rows], SCHEMA).repartition(4)
    got = near_dedup.groups(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == near_brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_kept_and_empty(spark, percent):
    z = "quite another text that no one else has written down"
    rows = near_rows() + [(7, near_rows()[40][1]), (7, z), (None, near_rows()[1][1]), (950, z + " once more"), (950, z + " once more"), (950, ""), (None, ""), (None, "null ids only share this text"), (None, "null ids only share this text")]
    df = spark.createDataFrame([(*r, i % 2 == 0, i, "en") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    out = near_dedup.kept(df, percent)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    # Every row without shingles stays, and exactly one row of every group: one with its smallest id.
    assert sorted((r for r in got if not (r[1] or "").split()), key=str) == sorted((r for r in rows if not (r[1] or "").split()), key=str)
    words = [r for r in got if (r[1] or "").split()]
    roots, least = near_brute(rows, percent, "groups")
    members = {}
    for row, root in zip(rows, roots, strict=True):
        if root is not None:
            members.setdefault(root, []).append(row)
    assert len(words) == len(members) and (7, z) in words
    for root, own in members.items():
        stay = [r for r in words if r in own]
        assert len(stay) == 1 and stay[0][0] == least.get(root)
    again = [(r["doc_id"], r["keep_id"]) for r in near_dedup.kept(df.repartition(2), percent).collect()]
    assert sorted(again, key=str) == sorted(((r["doc_id"], r["keep_id"]) for r in out.collect()), key=str)
    assert near_dedup.groups(df.where("false")).count() == 0 and near_dedup.kept(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """The number of tables grows with the logarithm of the longest path, whatever its order."""
    rng, tables = np.random.default_rng(6), []
    monkeypatch.setattr(near_dedup, "saved", lambda df, name: tables.append(name) or common.saved(df, name))
    for order in (np.arange(2001), rng.permutation(2001), np.r_[np.arange(0, 2001, 2), np.arange(1, 2001, 2)]):
        tables.clear()
        pairs = [(min(p), max(p)) for p in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
        got = near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert sorted((r["id"], r["comp"]) for r in got) == [(i, 0) for i in range(2001)]
        assert tables.count("near-edges") - 1 <= 15 and tables.count("near-map") <= 24


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(50)] + [(int(a), int(b)) for a, b in rng.integers(100, 160, (60, 2)) if a != b]
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert all(got[a] == got[b] for a, b in pairs) and all(v <= k for k, v in got.items())


def test_sketch_estimates(spark):
    rng = np.random.default_rng(4)
    for n in (40, 400, 20_000):
        for j in (0.8, 0.85, 0.9, 0.95):
            both = round(2 * n * j / (1 + j))
            items = np.unique(rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64))
            a, b = items[:n], items[-n:]
            (s_a, x), (s_b, y) = near_dedup.sketch(np.sort(a)), near_dedup.sketch(np.sort(b))
            z = np.array([int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum())])
            if j >= 0.85:
                assert near_dedup.possible(z, np.array([s_a]), np.array([s_b]), np.array([len(a)]), np.array([len(b)]))[0] or not near_dedup.linked(np.sort(a), np.sort(b))


def test_bands_agree_with_the_rate(spark):
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(30):
        items = np.unique(rng.integers(0, 1 << 63, 230, dtype=np.uint64) * np.uint64(2))
        a, b = near_dedup.bands(np.sort(items[:215])), near_dedup.bands(np.sort(items[15:]))
        met += (a == b).sum()
    rate = (200 / 230) ** near_dedup.ROWS
    assert met / (30 * near_dedup.BANDS) == pytest.approx(rate, abs=0.08)


def test_plans_use_no_cross_join(spark):
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string")
    for plan in (exact_dedup.classes(df), exact_dedup.kept(df), near_dedup.groups(df), near_dedup.kept(df)):
        assert not re.search("Cartesian|NestedLoop", plan._jdf.queryExecution().toString())


def test_near_threshold_of_the_pipeline(spark):
    """Sets of 82 in 100 shingles: near copies in the pipeline, none for op4."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(95)]
    # 91 shingles each, of which nine differ: 82 / 100.
    rows = [(1, " ".join(words)), (2, " ".join([*words[:86], *(f"v{i}" for i in range(9))])), (3, " ".join(f"u{i}" for i in range(60)))]
    df = spark.createDataFrame([(*r, True, 1, "en") for r in rows], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {1, 3}
    assert {r["doc_id"] for r in near_dedup.kept(df).collect()} == {1, 2, 3}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(df, 80).collect()} == {1: 1, 2: 1, 3: 3}
