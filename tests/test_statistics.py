import math

import numpy as np
import pytest

from netloom.functions import stats
from netloom.operators import cox, differential, regress, risk, survival


def test_distribution_functions():
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.t_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-8)
    assert stats.chi2_one(3.841458820694124) == pytest.approx(0.05)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert stats.kolmogorov(1.3580986393225505) == pytest.approx(0.05, abs=1e-6)
    assert stats.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)
    assert stats.mann_whitney_exact(4.0, 2, 2) == pytest.approx(1 / 3)
    assert stats.mann_whitney_exact(2.0, 2, 2) == 1


def markers(spark, a, b, extra=()):
    rows = [("t", float(x)) for x in a] + [("r", float(x)) for x in b] + list(extra)
    return spark.createDataFrame(rows, "g string, m double")


def test_three_tests_against_direct_counts(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 8, 30), rng.integers(2, 10, 25)
    df = markers(spark, a, b, [("t", None)])
    rows = differential.long(df, ["m"], differential.sides("g", "t"))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    got = differential.mann_whitney(rows).first()
    assert got["u"] == pytest.approx(u) and (got["n_tgt"], got["n_ref"]) == (30, 25)
    w = differential.welch(rows).first()
    va, vb = a.var(ddof=1) / 30, b.var(ddof=1) / 25
    assert w["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb)) and w["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 29 + vb**2 / 24))
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in range(11))
    assert differential.kolmogorov_smirnov(rows).first()["d"] == pytest.approx(d)


def test_empty_sides_and_order(spark):
    df = spark.createDataFrame([("t", 1.0, None), ("r", 2.0, 1.0), ("t", 0.5, None), ("r", 3.0, 4.0)], "g string, a double, b double")
    found = differential.find_markers(df, "g", "t").collect()
    assert [r["marker"] for r in found] == ["a"] and found[0]["pval"] == pytest.approx(1 / 3)
    assert differential.find_markers(df, "g", "t", ["r"], test="Welch").count() == 1
    assert differential.find_markers(df, "g", "t", "r", test="Kolmogorov-Smirnov", fdr_method=None).columns == ["marker", "pval"]


def test_false_discovery_rate(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "test string, pval double")
    got = {r["test"]: r["pval_corr"] for r in differential.fdr(p).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.5})
    assert all(r["pval_corr"] >= r["pval"] for r in differential.fdr(p, method="n").collect())
    with pytest.raises(ValueError):
        differential.fdr(p, method="?")


def test_relative_risk(spark):
    rows = spark.createDataFrame([(True, True), (True, True), (True, False), (True, False), (False, True), (False, False), (False, False), (False, False)], "exposed boolean, diseased boolean")
    r = risk.relative_risk(rows).first()
    assert (r["rr"], r["low"], r["high"]) == pytest.approx((2, 0.32829, 12.18426), abs=1e-4)
    r = risk.relative_risk(rows, variance="katz").first()
    assert (r["low"], r["high"]) == pytest.approx((0.28173, 14.19814), abs=1e-4)
    r = risk.relative_risk(rows, alpha=0.5).first()
    assert (r["low"], r["high"]) == pytest.approx((1.07390, 3.72474), abs=1e-4)


def test_risk_matrix(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 0, None), (0, 1, 1.0), (0, 0, float("nan")), (1, 1, 1.0), (0, 0, 0.0)], "a int, b int, c double")
    got = {(r["exposure"], r["disease"]): r for r in risk.risk_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "a"]["rr"] == 1 and not got["b", "b"]["significant"]
    assert got["a", "b"]["rr"] == pytest.approx((2 / 3) / (1 / 3))
    assert got["a", "c"]["rr"] == pytest.approx((1 / 2) / (1 / 2))
    some = risk.risk_matrix(df, ["a", "b"], filters={"a": {"all": df["c"].isNotNull()}})
    assert {(r["exposure"], r["disease"]): r["rr"] for r in some.collect()}["a", "b"] == pytest.approx(3.0)


def brute_logrank(v, t, e, cut):
    gap = var = 0.0
    g = v > cut
    for s in sorted(set(t[e])):
        n, n1, d, d1 = (t >= s).sum(), ((t >= s) & g).sum(), ((t == s) & e).sum(), ((t == s) & e & g).sum()
        gap += d1 - d * n1 / n
        if n > 1:
            var += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)
    return gap, var


def test_survival(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=80)
    t = np.ceil(rng.exponential(10 / np.exp(v))) + 1
    e = rng.random(80) < 0.7
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(v, t, e, strict=True)], "v double, t double, e int")
    for r in survival.scan_thresholds(df, "v", "t", "e").collect():
        assert r["threshold"] == pytest.approx(np.percentile(v, r["percentile"]))
        assert (r["gap"], r["variance"]) == pytest.approx(brute_logrank(v, t, e, r["threshold"]))
    best = survival.best_threshold(df, "v", "t", "e").first()
    assert best["pval"] < 0.01
    curve = survival.kaplan_meier(df, "v", "t", "e", 0.0).where("above").orderBy("time").collect()
    s, group = 1.0, v > 0
    for r in curve:
        n, d = ((t >= r["time"]) & group).sum(), ((t == r["time"]) & e & group).sum()
        s *= 1 - d / n
        assert r["survival"] == pytest.approx(s, abs=1e-12) and r["low"] <= r["survival"] + 1e-12 and r["high"] >= r["survival"] - 1e-12
    c = survival.concordance(df, "v", "t", "e").first()["cindex"]
    assert c == pytest.approx(regress.c_index(v, t, e)) and c > 0.6


def test_survival_ends_at_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1), (1.0, 2.0, 1)], "v double, t double, e int")
    assert [r["survival"] for r in survival.kaplan_meier(df, "v", "t", "e", 0.0).orderBy("time").collect()] == [0.5, 0.0]
    assert survival.scan_thresholds(df, "v", "t", "e", (50,)).first()["chi2"] is None


def test_hazard_table_and_significance(spark):
    coefs = spark.createDataFrame([("a", 0.5, 0.1), ("b", -0.1, 0.2)], "variable string, coef double, se double")
    rows = survival.hazard_table(coefs).collect()
    assert [r["variable"] for r in rows] == ["b", "a"] and rows[1]["hr"] == pytest.approx(math.exp(0.5))
    table = spark.createDataFrame([("a", 0.1, 0.2), ("b", -0.1, 0.2), ("c", -3.0, -1.0)], ["v", "95% lower-bound", "95% upper-bound"])
    assert [r["v"] for r in differential.significant(table).collect()] == ["a", "c"]


def linear(spark, n=200):
    x = np.random.default_rng(5).normal(size=(n, 4))
    y = 2 * x[:, 0] - x[:, 2] + np.random.default_rng(6).normal(size=n)
    rows = [(i, *map(float, x[i]), float(y[i]), int(y[i] > 0), 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, z int, one double")


def test_stepwise(spark):
    df, columns = linear(spark), ["a", "b", "c", "d"]
    assert set(regress.forward(df, "y", columns, 0.001)) == {"a", "c"}
    assert set(regress.backward(df, "y", columns, 0.001)) == {"a", "c"}
    assert set(regress.stepwise(df, "y", [*columns, "one"], 0.001, 0.001)) == {"a", "c"}
    assert set(regress.forward(df, "z", columns, 0.001, "logit")) == {"a", "c"}
    assert regress.support_filter(df, ["a", "one"]) == ["a"]


def test_logistic(spark):
    out = regress.logistic(linear(spark), "z", ["a", "b", "c", "d"], "id", c_values=(1.0,), l1_ratios=(0.5,), folds=2)
    coef = {r["variable"]: r["coef"] for r in out["coef"].collect()}
    assert coef["a"] > 0.5 and coef["c"] < -0.2 and abs(coef["b"]) < 0.3
    scores = out["scores"].first()
    assert scores["auc"] > 0.85 and scores["mcc"] > 0.4 and scores["ap"] > 0.8


def test_cox_recovers_effects():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    t, e = rng.exponential(1 / np.exp(x @ [1.0, 0.0, -0.5])), rng.random(400) < 0.8
    beta = regress.cox_fit(x, t, e, 1e-4, 0.5)
    assert beta == pytest.approx([1.0, 0.0, -0.5], abs=0.2)
    assert (regress.cox_fit(x, t, e, 10.0, 1.0) == 0).all()


def test_cox_and_univariate(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 2))
    t = rng.exponential(1 / np.exp(x[:, 0]))
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(t[i]), 1) for i in range(150)], "id long, a double, b double, t double, e int")
    out = regress.cox(df, "t", "e", ["a", "b"], "id", l1_ratios=(0.5,), n_alphas=4, folds=3)
    coef = {r["variable"]: r["coef"] for r in out["coef"].collect()}
    assert coef["a"] > 0.5 > abs(coef["b"]) and out["score"] > 0.7
    assert regress.find_survival_variable(df, "t", "e", ["a", "b"]).first()["variable"] == "a"
    with pytest.raises(NotImplementedError):
        regress.boosted()


@pytest.mark.parametrize("times", [1000, 7, 1])
def test_cox_across_blocks(spark, monkeypatch, times):
    """Passes over blocks of falling time against the fit of all subjects at once; times repeat, within
    and across blocks."""
    rng = np.random.default_rng(times)
    x = rng.normal(size=(300, 3))
    t = np.ceil(rng.exponential(1 / np.exp(x @ [0.8, 0.0, -0.5])) * times) if times > 1 else np.ones(300)
    e = rng.random(300) < 0.7
    df = spark.createDataFrame([(i, *map(float, x[i]), float(t[i]), int(e[i])) for i in range(300)], "id long, a double, b double, c double, t double, e int")
    monkeypatch.setattr(cox, "BLOCK", 23)
    blocks = cox.cohort(df, "t", "e", ["a", "b", "c"], "id", 3)
    assert blocks.count() >= 300 / 23
    rows = [cox.opened(r) for r in blocks.collect()]
    t2, e2, fold, x2 = (np.concatenate(v) for v in zip(*rows, strict=True))
    settings = [(0.01, 0.5, -1), (0.05, 1.0, -1), (0.02, 0.1, 1)]
    for (alpha, l1, out), beta in zip(settings, cox.fits(blocks, settings, [np.zeros(3)] * 3), strict=True):
        inn = fold != out
        assert beta == pytest.approx(regress.cox_fit(x2[inn], t2[inn], e2[inn], alpha, l1), abs=1e-5)


def test_cox_models_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    t = np.ceil(rng.exponential(1 / np.exp(x[:, 0])) * 20)
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(t[i]), 1) for i in range(120)], "id long, a double, b double, t double, e int")
    fit = lambda: regress.cox(df, "t", "e", ["a", "b"], "id", l1_ratios=(0.5,), n_alphas=2, folds=2)
    here = fit()
    monkeypatch.setattr(cox, "BLOCK", 40)
    there = fit()
    assert there["params"] == pytest.approx(here["params"]) and there["score"] == pytest.approx(here["score"])
    assert [r["coef"] for r in there["coef"].collect()] == pytest.approx([r["coef"] for r in here["coef"].collect()], abs=1e-5)


@pytest.mark.parametrize("times,scores,ranges", [(1000, 1000, 16), (9, 5, 4), (50, 1000, 8), (1000, 3, 8), (1, 40, 4), (60, 60, 2)])
def test_concordance_by_ranges(spark, monkeypatch, times, scores, ranges):
    """Against all pairs, with repeated times and scores, in two groups at once."""
    monkeypatch.setattr(survival, "RANGES", ranges)
    rng = np.random.default_rng(times + scores)
    t, v, e, g = rng.integers(0, times, 400), rng.integers(0, scores, 400), rng.random(400) < 0.6, rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(v[i]), float(t[i]), int(e[i]), int(g[i])) for i in range(400)] + [(None, 1.0, 1, 0)], "v double, t double, e int, g int")
    for r in survival.concordances(df, "v", "t", "e", ["g"]).collect():
        own = g == r["g"]
        later = (t[own][None] > t[own][:, None]) | ((t[own][None] == t[own][:, None]) & ~e[own][None])
        pairs = later & e[own][:, None]
        want = (pairs & (v[own][:, None] > v[own][None])).sum(), (pairs & (v[own][:, None] == v[own][None])).sum(), pairs.sum()
        assert (r["concordant"], r["tied"], r["comparable"]) == want


def orders(n, m):
    """Every order of n values of one side (1) and m of the other (0)."""
    from itertools import combinations

    for at in combinations(range(n + m), n):
        yield np.isin(np.arange(n + m), at).astype(int)


@pytest.mark.parametrize("n,m", [(1, 1), (3, 4), (5, 5), (2, 9), (6, 4)])
def test_exact_distributions_against_every_order(n, m):
    gaps, us = [], []
    for side in orders(n, m):
        gaps.append(int(np.abs(np.cumsum(side) * m - np.cumsum(1 - side) * n).max()))
        us.append(int(sum((side[:i] == 0).sum() for i in np.flatnonzero(side))))
    for gap in set(gaps):
        assert stats.kolmogorov_exact(gap, n, m) == pytest.approx(np.mean(np.array(gaps) >= gap))
        assert stats.kolmogorov_two_sample(gap / (n * m), n, m) == pytest.approx(np.mean(np.array(gaps) >= gap))
    for u in set(us):
        top = max(u, n * m - u)
        assert stats.mann_whitney_exact(u, n, m) == pytest.approx(min(1, 2 * np.mean(np.array(us) >= top)))


def test_exact_tests_know_no_other_limit():
    """Few values against many: exact, and close to the normal's p."""
    for m in (2_000, 20_000):
        u, sd = 8 * m / 2 + 1.5 * m, np.sqrt(8 * m / 12 * (8 + m + 1))
        exact = differential.mann_whitney_p(u, 8, m, 0)
        assert exact == stats.mann_whitney_exact(u, 8, m) == pytest.approx(stats.normal_two_sided((u - 4 * m) / sd), rel=0.1)
    assert stats.kolmogorov_two_sample(0.03, 10_000, 10_000) == pytest.approx(stats.kolmogorov(0.03 * math.sqrt(5000)), rel=0.02)
    assert stats.kolmogorov_two_sample(0.03, 10_001, 10_000) == pytest.approx(stats.kolmogorov(0.03 * math.sqrt(10_001 * 10_000 / 20_001)))


@pytest.mark.parametrize("descending,own", [(False, True), (True, True), (False, False)])
def test_running_sums_by_ranges(spark, monkeypatch, descending, own):
    from netloom.functions import ranks

    monkeypatch.setattr(ranks, "ACCURACY", 100)
    rng = np.random.default_rng(0)
    rows = [(g, float(v), int(rng.integers(0, 5))) for g, n in (("a", 500), ("b", 3), ("c", 1)) for v in set(np.round(rng.lognormal(0, 3, n), 2).tolist())]
    df = spark.createDataFrame(rows, "g string, v double, x long").repartition(3)
    for by in (["g"], []):
        one = df if by else df.where("g = 'a'")
        got = ranks.running(one, by, "v", {"s": "x"}, descending, own).collect()
        mine = [r for r in rows if by or r[0] == "a"]
        assert len(got) == len(mine)
        for r in got:
            before = [x for g, v, x in mine if g == r["g"] and (v > r["v"] if descending else v < r["v"])]
            assert r["s"] == sum(before) + (r["x"] if own else 0)


def test_no_window_over_a_whole_column(spark):
    """Ranks and running sums of a marker or a curve are shared by the ranges of its values."""
    df = spark.createDataFrame([(float(i % 7), float(i), i % 2, "t" if i % 3 else "r") for i in range(60)], "v double, t double, e int, g string")
    rows = differential.long(df, ["v", "t"], differential.sides("g", "t"))
    for out in (differential.mann_whitney(rows), differential.kolmogorov_smirnov(rows), survival.scan_thresholds(df, "v", "t", "e"), survival.kaplan_meier(df, "v", "t", "e", 3.0), regress.auc(df, "v", "e")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_range" in line for line in windows)


def test_blocks_of_subjects_never_pass_the_driver(spark):
    """Not the blocks but the few numbers told to them are broadcast, small as the blocks may be."""
    blocks = spark.createDataFrame([(b, bytes(8)) for b in range(3)], "block long, t binary").cache()
    blocks.count()
    met = cox._beside(blocks, cox._told(blocks, [0, 1, 2], np.arange(6.0).reshape(3, 2)))
    assert "BuildRight" in met._jdf.queryExecution().executedPlan().toString()
    assert [np.frombuffer(r["told"]).tolist() for r in met.orderBy("block").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_logistic_tables(spark):
    """Models fitted in a task are those that Spark fits."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] - x[:, 1] / 2 + rng.normal(size=80) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y int")
    options = {"c_values": (0.05, 1.0), "l1_ratios": (0.0, 0.5), "folds": 3, "most_folds": 4}
    want = regress.logistic(df, "y", ["a", "b", "c"], "id", **options)
    score = want["scores"].first()
    tables = df.select(F.explode(F.array(F.lit("t"), F.lit("u"))).alias("name"), "id", "y", F.array("a", "b", "c").alias("x"))
    got = regress.logistic_tables(tables, "name", "y", "x", "id", **options).collect()
    assert sorted(r["name"] for r in got) == ["t", "u"]
    for r in got:
        assert (r["penalty"], r["l1_ratio"], r["n_coeffs"]) == (want["params"]["C"], want["params"]["l1_ratio"], want["model"].coefficients.numNonzeros())
        assert [r["score_roc_auc"], r["score_ap"], r["score_mcc"]] == pytest.approx([score["auc"], score["ap"], score["mcc"]])
    train = np.ones(80, bool)
    beta, base = regress.elastic_nets(x, y, train[None], np.array([0.02]), np.array([0.5]))
    p = 1 / (1 + np.exp(-(x @ beta[0] + base[0])))
    slope = x.T @ (p - y) / 80 + 0.01 * beta[0]
    assert abs((p - y).sum()) < 1e-3 and all(abs(g + 0.01 * np.sign(b)) < 1e-4 if b else abs(g) <= 0.01 + 1e-4 for g, b in zip(slope, beta[0], strict=True))
