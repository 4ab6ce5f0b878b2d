"""Searches between groups and batch correction against brute force."""

import numpy as np
import pytest

from netloom.operators import across, blocked, graphs, preprocess

POINT = "grp long, side long, ask boolean, id long, v array<double>, w array<double>"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK", 16)
    monkeypatch.setattr(blocked, "BOXES", 3)
    monkeypatch.setattr(blocked, "SLAB", 100)
    monkeypatch.setattr(across, "FEW", 0)


def squared(x, y):
    return ((x[:, None] - y) ** 2).sum(-1)


@pytest.mark.parametrize("dim", [1, 3, 9])
def test_nearest_of_other_sides(spark, small, dim):
    rng = np.random.default_rng(dim)
    x, side = rng.normal(size=(120, dim)).round(1), rng.choice([0, 0, 0, 1, 2], 120)
    x[side == 2] += 4
    df = spark.createDataFrame([(0, int(s), True, i, [float(c) for c in v], None) for i, (s, v) in enumerate(zip(side, x, strict=True))], POINT).repartition(3)
    got = {}
    for r in across.nearest(across.packed(df), 4).collect():
        assert r["here"] == side[r["src"]] and r["there"] == side[r["dst"]]
        got.setdefault(r["src"], set()).add(r["dst"])
    d = squared(x, x)
    d[side[:, None] == side] = np.inf
    for i in range(120):
        assert got[i] == set(np.lexsort((np.arange(120), d[i]))[:4].tolist())


def test_fewer_points_than_asked_for(spark, small):
    df = spark.createDataFrame([(0, i % 2, True, i, [float(i)], None) for i in range(5)], POINT)
    got = sorted((r["src"], r["dst"]) for r in across.nearest(across.packed(df), 9).collect())
    assert got == [(i, j) for i in range(5) for j in range(5) if i % 2 != j % 2]


@pytest.mark.parametrize("width", [0.01, 1.0, 50.0])
def test_kernel_means(spark, small, width):
    rng = np.random.default_rng(7)
    x, y, u = rng.normal(size=(60, 3)), rng.normal(size=(70, 3)) + 1, rng.normal(size=(70, 3))
    rows = [(g, 0, True, 100 * g + i, [float(c) for c in x[i]], None) for g in (1, 2) for i in range(60)]
    rows += [(g, 1, False, j, [float(c) for c in y[j]], [*(float(c) * g for c in u[j]), 1.0 + j % 2]) for g in (1, 2) for j in range(70)]
    df = spark.createDataFrame(rows, POINT)
    got = {r["id"]: r["move"] for r in across.kernel_means(across.packed(df), {1: width, 2: width}, 3).collect()}
    d = squared(x, y)
    w = np.exp(-(d - d.min(1, keepdims=True)) / width)
    want = (w @ u) / (w @ (1.0 + np.arange(70) % 2))[:, None]
    assert len(got) == 120
    for i in range(60):
        assert np.allclose(got[100 + i], want[i], atol=1e-9) and np.allclose(got[200 + i], 2 * want[i], atol=1e-9)


def brute(x, batch, k, rounds, least):
    """The same rule on one machine."""
    names, counts = np.unique(batch, return_counts=True)
    order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
    code = {names[i]: n + 1 for n, i in enumerate(order)}
    own = np.array([code[b] for b in batch])
    sizes = {code[n]: int(c) for n, c in zip(names, counts, strict=True)}
    x, ids = x.copy(), np.arange(len(x))
    for _ in range(rounds):
        d = squared(x, x)
        d[own[:, None] == own] = np.inf
        near = [set(np.lexsort((ids, d[i]))[:k].tolist()) for i in ids]
        match = [(i, j) for i in ids for j in near[i] if i in near[j]]
        score = {}
        for a in sizes:
            for b in sizes:
                n = len({i for i, j in match if own[i] == a and own[j] == b})
                if n:
                    pair = (min(a, b), max(a, b))
                    score[pair] = max(score.get(pair, 0), n / sizes[a])
        score = {p: s for p, s in score.items() if s >= least}
        part = {b: b for b in sizes}
        while moves := preprocess.merges(score, part, sizes):
            new = x.copy()
            for p, q in moves.items():
                pairs = [(i, j) for i, j in match if part[own[i]] == p and part[own[j]] == q]
                at = sorted({i for i, _ in pairs})
                total = np.array([sum(x[j] - x[i] for i, j in pairs if i == a) for a in at])
                times = np.array([sum(i == a for i, _ in pairs) for a in at])
                width = x[at].var(0).sum() + 1e-12
                rows = np.array([part[b] == p for b in own])
                e = squared(x[rows], x[at])
                w = np.exp(-(e - e.min(1, keepdims=True)) / width)
                new[rows] = x[rows] + (w @ total) / (w @ times)[:, None]
            x = new
            part = {b: moves.get(p, p) for b, p in part.items()}
    return x


def corrected(spark, x, batch, parts=4, **how):
    rows = [(i, batch[i], *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "node_id long, patient string, a double, b double").repartition(parts)
    out = preprocess.batch_correct(df, ["a", "b"], **how).toPandas().sort_values("node_id")
    assert out["node_id"].tolist() == list(range(len(x))) and out["patient"].tolist() == list(batch)
    return out[["a", "b"]].to_numpy()


def test_batch_correction_equals_brute_force(spark, small):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(140, 2)) + rng.integers(0, 2, 140)[:, None] * 5.0
    batch = [f"p{int(i)}" for i in rng.choice(4, 140, p=[0.4, 0.3, 0.2, 0.1])]
    x += np.array([[int(b[1]) * 0.8, 0] for b in batch])
    got = corrected(spark, x, batch, k=5, rounds=2, least=0.05)
    assert np.allclose(got, brute(x, np.array(batch), 5, 2, 0.05), atol=1e-7)


def test_unmatched_batches_and_odd_rows_stay(spark):
    rows = [(1, "a", 1.0, 2.0), (1, "a", 1.5, 2.0), (2, "b", None, 1.0), (3, "b", float("nan"), 1.0), (None, None, 3.0, 3.0), (4, "b", 1.1, 2.1)]
    df = spark.createDataFrame(rows, "node_id long, patient string, x double, _row double")
    out = preprocess.batch_correct(df, ["x"], rounds=1)
    assert out.columns == df.columns and out.count() == 6
    assert sorted(r["_row"] for r in out.collect()) == [1.0, 1.0, 2.0, 2.0, 2.1, 3.0]
    assert [r["x"] for r in out.where("patient is null").collect()] == [3.0]
    one = df.where("patient = 'a'")
    assert sorted(r["x"] for r in preprocess.batch_correct(one, ["x"]).collect()) == [1.0, 1.5]
    assert preprocess.batch_correct(df.where("false"), ["x"]).count() == 0


def test_merges_form_trees():
    sizes = {1: 50, 2: 40, 3: 30, 4: 20, 5: 10}
    scores = {(1, 2): 0.9, (2, 3): 0.8, (3, 4): 0.7}
    part = {b: b for b in sizes}
    rounds = 0
    while moves := preprocess.merges(scores, part, sizes):
        assert not set(moves) & set(moves.values())
        part = {b: moves.get(p, p) for b, p in part.items()}
        rounds += 1
    assert part == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5} and rounds <= 2


def test_fewer_principal_components(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(scale=5, size=80), rng.normal(scale=0.01, size=80)]
    batch = [f"p{i % 2}" for i in range(80)]
    x[::2] += [0, 3]
    got = corrected(spark, x, batch, max_dims=1, rounds=2)
    assert abs(got[::2, 1].mean() - got[1::2, 1].mean()) < 0.1


def test_isolated_nodes_of_many_networks(spark, small):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for net, n in (("one", 150), ("two", 40), ("three", 3), ("four", 1)):
        xy = rng.integers(0, 12, (n, 2)).astype(float)
        rows += [(net, "0", i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
        d = squared(xy, xy)
        np.fill_diagonal(d, np.inf)
        for i in range(n):
            if net != "one" or i >= 20:
                want |= {(net, min(i, j), max(i, j)) for j in np.lexsort((np.arange(n), d[i]))[:2].tolist() if j != i}
    rows += [("two", "0", 99, None, 1.0), ("two", "0", 98, float("nan"), 1.0)]
    nodes = spark.createDataFrame(rows, "patient string, sample string, node_id long, x double, y double").repartition(5)
    edges = spark.createDataFrame([("one", "0", i, i + 1) for i in range(0, 20, 2)], "patient string, sample string, source long, target long")
    got = [(r["patient"], r["source"], r["target"]) for r in graphs.link_isolated(nodes, edges).collect()]
    assert sorted(got) == sorted([*want, *(("one", i, i + 1) for i in range(0, 20, 2))])
    full = graphs.link_isolated(nodes.where("patient = 'one' and node_id < 20"), edges)
    assert full.count() == 10 and full.columns == ["patient", "sample", "source", "target"]


@pytest.fixture
def tiny(monkeypatch):
    for name, n in (("LEAF", 16), ("CHUNK", 2), ("SPLIT", 100), ("STEP", 2), ("PIECE", 5)):
        monkeypatch.setattr(across, name, n)
    monkeypatch.setattr(blocked, "BOXES", 3)


def sided(spark, x, side, parts=3):
    return spark.createDataFrame([(i, int(s), [float(c) for c in v]) for i, (s, v) in enumerate(zip(side, x, strict=True))], "id long, side long, v array<double>").repartition(parts)


@pytest.mark.parametrize("case", ["mixed", "apart", "copies", "few"])
def test_nearest_of_other_sides_among_leaves(spark, tiny, case):
    rng = np.random.default_rng(5)
    x, side = rng.normal(size=(300, 4)).round(1), rng.choice([0, 0, 0, 1, 2], 300)
    if case == "apart":
        x += side[:, None] * 20.0
    elif case == "copies":
        x[rng.permutation(300)[:150]] = 0.5
    elif case == "few":
        x, side = x[:7], np.array([0, 0, 0, 0, 1, 1, 0])
    got = {}
    for r in across.nearest_others(across.leaves(sided(spark, x, side), 4), 4).collect():
        assert r["here"] == side[r["src"]] and r["there"] == side[r["dst"]]
        got.setdefault(r["src"], []).append(r["dst"])
    d = squared(x, x)
    d[side[:, None] == side] = np.inf
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:4]
        assert sorted(got[i]) == sorted(order[np.isfinite(d[i][order])].tolist())


def test_leaves_met_grow_with_the_points(spark, monkeypatch):
    """Four times the points meet some four times the leaves, not sixteen times: sides share their leaves."""
    for name, n in (("LEAF", 16), ("CHUNK", 2)):
        monkeypatch.setattr(across, name, n)
    rng, met, written = np.random.default_rng(6), [], blocked.written

    def counted(df, name):
        out = written(df, name)
        if name == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(blocked, "written", counted)
    for n in (1500, 6000):
        points = sided(spark, rng.uniform(size=(n, 2)), rng.integers(0, 5, n)).withColumnRenamed("side", "batch")
        preprocess.mutual_matches(points, 4)
    assert len(met) == 2 and met[1] < 6 * met[0]


def test_sums_of_a_block_are_added_before_they_are_shuffled(spark, small, monkeypatch):
    rng, rows, written = np.random.default_rng(8), [], blocked.written

    def counted(df, name):
        out = written(df, name)
        if name == "sums":
            rows.append(out.count())
        return out

    monkeypatch.setattr(across, "ADDED", 16)
    monkeypatch.setattr(blocked, "written", counted)
    points = [(1, 0, True, i, [float(c) for c in v], None) for i, v in enumerate(rng.normal(size=(40, 3)))]
    points += [(1, 1, False, i, [float(c) for c in v], [1.0, 2.0, 3.0, 1.0]) for i, v in enumerate(rng.normal(size=(200, 3)))]
    moves = across.kernel_means(across.packed(spark.createDataFrame(points, POINT)), {1: 5.0}, 3).collect()
    assert len(moves) == 40 and rows == [40]
    assert all(np.allclose(r["move"], [1.0, 2.0, 3.0]) for r in moves)
