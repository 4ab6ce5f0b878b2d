import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import clean, curate, niches, plotdata, preprocess


def frame(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def test_composition_of_niches(spark):
    df = frame(spark, var=list("xxxyyz"), niche=[0, 0, 1, 1, 1, 0])
    want = {
        "total": {"x": (1 / 3, 1 / 6), "y": (0, 1 / 3), "z": (1 / 6, 0)}, "obs": {"x": (2 / 3, 1 / 3), "y": (0, 1), "z": (1, 0)},
        "niche": {"x": (2 / 3, 1 / 3), "y": (0, 2 / 3), "z": (1 / 3, 0)}, "niche&obs": {"x": (0.4, 0.25), "y": (0, 0.75), "z": (0.6, 0)},
        "clr": {"x": (0.34657359, -0.34657359), "y": (-5.75646273, 5.75646273), "z": (5.40988914, -5.40988914)}, "counts": {"x": (2, 1), "y": (0, 2), "z": (1, 0)},
    }
    for how, rows in want.items():
        got = {r["var"]: (r["0"], r["1"]) for r in niches.wide(niches.composition(df, "var", "niche", how), "var", "niche", [0, 1]).collect()}
        assert {k: pytest.approx(v, abs=1e-8) for k, v in rows.items()} == got, how
    assert {r["niche"]: r["n"] for r in niches.histogram(df, "niche").collect()} == {0: 3, 1: 3}


def test_rescale(spark):
    df = frame(spark, a=[1.0, 2.0, 3.0], b=[5.0, 5.0, 5.0])
    rows = preprocess.rescale(df, ["a", "b"], -1, 1).collect()
    assert [r["a"] for r in rows] == [-1, 0, 1] and [r["b"] for r in rows] == [None] * 3


def test_clr_rows_sum_to_zero(spark):
    df = frame(spark, a=[0, 2, 5], b=[1, 0, 5], g=["x", "y", "y"])
    for groups in ((), ("g",)):
        rows = preprocess.transform(df, ["a", "b"], groups=groups).collect()
        assert all(r["a"] + r["b"] == pytest.approx(0, abs=1e-12) for r in rows)
    row = preprocess.transform(df, ["a", "b"]).where("g = 'x'").first()
    assert row["a"] == pytest.approx(math.log(5e-5) / 2)
    assert preprocess.transform(df, ["a"], "logp1").where("g = 'x'").first()["a"] == 0
    with pytest.raises(ValueError):
        preprocess.transform(df, ["a"], "sqrt")


def test_batch_correction_removes_a_shift(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0]])
    x = centres[rng.integers(0, 3, 300)] + rng.normal(scale=0.3, size=(300, 3))
    batch = np.arange(300) % 2
    x[batch == 1] += [0, 0, 2.0]
    df = spark.createDataFrame([(i, int(batch[i]), *map(float, x[i])) for i in range(300)], "node_id long, patient int, a double, b double, c double")
    out = preprocess.batch_correct(df, ["a", "b", "c"]).toPandas().sort_values("node_id")
    gap = abs(out[out.patient == 0].c.mean() - out[out.patient == 1].c.mean())
    assert gap < 0.3 and len(out) == 300


def test_clean(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, float("inf"), None), (3, 3.0, 4.0)], "id int, a double, b double")
    kept, selector = clean.clean(df, ["a", "b"], "drop", thresh=1.0, axis=1)
    assert kept.count() == 3
    kept, selector = clean.clean(df, ["a", "b"], "drop", thresh=0.5, axis=1)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3] and selector.count() == 3
    kept, names = clean.clean(df, ["a", "b"], "drop", thresh=0.5)
    assert names == ["a"] and kept.columns == ["id", "a"]
    kept, names = clean.clean(df, ["a", "b"], "drop", thresh=2)
    assert names == ["a", "b"]


def test_imputation(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i if i != 3 else None) for i in range(7)], "id int, a double, b double")
    row = {r["id"]: r["b"] for r in clean.impute(df, ["a", "b"], k=2).collect()}
    assert row[3] == pytest.approx(6) and row[5] == 10
    assert {r["b"] for r in clean.impute(df, ["a", "b"], k=2, categorical=["b"]).where("id = 3").collect()} == {6.0}


def test_imputation_searches_near_blocks(spark, monkeypatch):
    """By patterns of gaps and near blocks as by all pairs, with copies and ties, and not all pairs."""
    from netloom.operators import across, blocked

    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(0, 50, (400, 3)), 1)
    x[:, 1] //= 10
    x[rng.random(x.shape) < 0.2] = np.nan
    x = np.concatenate([x, x[:60], x[:20]])
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    rows = lambda: {r["id"]: (r["a"], r["b"], r["c"]) for r in clean.impute(df, ["a", "b", "c"], k=4).collect()}
    with monkeypatch.context() as m:
        m.setattr(clean, "PATTERNS", 0)
        want = rows()
    monkeypatch.setattr(blocked, "BLOCK", 40)
    monkeypatch.setattr(across, "FEW", 2)
    monkeypatch.setattr(clean, "_paired", None)
    got = rows()
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_dummies(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, None, "q"), (3, "y", None)], "id int, u string, v string")
    rows = {r["id"]: r.asDict() for r in clean.dummies(df, {"u": ["x", "y", "z"], "v": ["p", "q"]}).collect()}
    assert rows[1] == {"id": 1, "u_x": 1, "u_y": 0, "u_z": 0, "v_q": 0}
    assert rows[2]["u_x"] is None and rows[3]["v_q"] is None and rows[2]["v_q"] == 1
    assert clean.dummies(df, {"u": ["x"]}, thresh=0.9).columns == ["id", "v"]


def test_median_split_extract_composed(spark):
    df = frame(spark, a=[24.0, 24.0, 24.0], b=[12.0, 8.0, 8.0], c=[6.0, 4.0, 3.0], d=[3.0, 4.0, 1.0])
    second = clean.composed(df, list("abcd"), "ratio").collect()[1]
    assert [second[k] for k in ("a / b", "a / c", "a / d", "b / c", "b / d", "c / d", "(a / b) / (c / d)")] == [3, 6, 6, 2, 2, 1, 3]
    assert clean.composed(df, ["a", "b"]).columns == ["a / ( a + b )"]
    with pytest.raises(ValueError):
        clean.composed(df, ["a", "b"], "sum")
    assert [r["> med( b )"] for r in clean.median_split(df, ["b"]).select("> med( b )").collect()] == [True, False, False]
    y = frame(spark, y=["u", "v", "w"], x=[1, 2, 3])
    assert [(r["x"], r["y"]) for r in clean.extract(y, "y", ["v", "u"]).orderBy("x").collect()] == [(1, 1), (2, 0)]
    assert [r["y"] for r in clean.extract(y, "y", ["v", "u"], as_binary=False).orderBy("x").collect()] == ["u", "v"]


def test_relabel_is_dense(spark):
    df = frame(spark, id=[1, 2, 3, 4], label=[4, 0, 1, 4])
    assert {r["id"]: r["label"] for r in curate.relabel(df).collect()} == {1: 2, 2: 0, 3: 1, 4: 2}
    noise = frame(spark, id=[1, 2], label=[-1, 7])
    assert {r["id"]: r["label"] for r in curate.relabel(noise).collect()} == {1: 0, 2: 1}


def test_merge_smallest(spark):
    xs = [0, 1, 2, 3, 10, 11, 12, 13, 9.4]
    df = frame(spark, id=list(range(9)), x=[float(x) for x in xs], y=[0.0] * 9, label=[0] * 4 + [1] * 4 + [2])
    merged, done = curate.merge_smallest(df, ["x", "y"], size_thresh=2)
    assert done and merged.where("id = 8").first()["label"] == 1
    same, done = curate.merge_smallest(df, ["x", "y"])
    assert not done and same is df
    assert curate.merge_until(df, ["x", "y"], at_most=1, force=True).select("label").distinct().count() == 1
    with pytest.raises(ValueError):
        curate.merge_until(df, ["x", "y"], force=True)


def test_plot_tables(spark):
    df = frame(spark, g=["u", "u", "v"], a=[1.0, 3.0, float("nan")], b=[1.0, 1.0, 1.0])
    assert plotdata.distributions(df, "g", ["a", "b"]).count() == 5
    assert plotdata.z_scored(df.where("g = 'u'"), ["a", "b"]).columns == ["a"]
    box = plotdata.box_stats(plotdata.distributions(df, "g", ["a"]), "g").first()
    assert (box["low"], box["median"], box["high"]) == (1, 2, 3)
    colors = plotdata.cluster_colors([-1, 3, 5, 2, 4, 1, 3, -1])
    assert list(colors)[-1] == -1 and len(set(colors.values())) == 6
    assert len(set(plotdata.cluster_colors(range(24)).values())) == 24
    z = frame(spark, a=[1.0, 2.0, 3.0], b=[3.0, 2.0, 1.0], c=[1.0, 2.0, 3.1])
    assert set(plotdata.linkage_order(z, ["a", "b", "c"])[:2]) == {"a", "c"}
    top = frame(spark, marker=["m", "n", "o"], pval_corr=[0.01, 0.2, 0.001])
    assert [r["marker"] for r in plotdata.top_markers(top, 1).collect()] == ["o"]
    assert [r[0] for r in top.select(plotdata.color_below(F.col("pval_corr"))).collect()].count("background-color: green") == 2


def test_imputation_searches_all_rows(spark, monkeypatch):
    """Each gap's value has one donor at distance 0 among 7,000 distinct rows."""
    rows = [(i, float(i), float(10 * i)) for i in range(7000)] + [(10_000 + i, float(i), None) for i in range(0, 7000, 500)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r["id"]: r["b"] for r in clean.impute(df, ["a", "b"], k=3).where("id >= 10000").collect()}
    # The donor at distance 0 alone counts.
    assert got == {10_000 + i: 10.0 * i for i in range(0, 7000, 500)}
    hot = spark.createDataFrame([(i, 5.0, 1.0) for i in range(50)] + [(60, 5.5, 9.0), (61, 9.0, 8.0), (62, 9.0, None), (63, 5.5, None)], "id long, a double, b double")
    monkeypatch.setattr(clean, "BLOCK", 2)
    got = {r["id"]: r["b"] for r in clean.impute(hot, ["a", "b"], k=2).where("b is not null and id > 60").collect()}
    assert got[62] == 8.0 and got[63] == 9.0


def test_binarize_keeps_other_values(spark):
    text = spark.createDataFrame([("O",), ("F",), ("P",), (None,)], "s string").select(clean.binarize(F.col("s"), "O", "F").alias("y"))
    assert [r["y"] for r in text.collect()] == ["0", "1", "P", None]
    number = spark.createDataFrame([(3,), (5,), (7,)], "s int").select(clean.binarize(F.col("s"), 3, 5).alias("y"))
    assert [r["y"] for r in number.collect()] == [0, 1, 7]


def test_merging_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(curate, "SLICE", 3)
    monkeypatch.setattr(curate, "GROUP", 1)
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), label) for i, (label, at) in enumerate([(0, 0), (1, 4), (2, 8)] * 10 + [(3, 9)] * 7) for x, y in [rng.normal(at, 1, 2)]]
    df = spark.createDataFrame(rows, "id long, x double, y double, label long").repartition(3)
    out, merged = curate.merge_smallest(df, ["x", "y"], force=True)
    small, others = [r for r in rows if r[3] == 3], [r for r in rows if r[3] != 3]
    near = sorted(min(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[3]) for b in others) for a in small)[:10]
    votes = [label for _, label in near]
    want = min(set(votes), key=lambda v: (-votes.count(v), v))
    assert merged and {r["label"] for r in out.where("id >= 30").collect()} == {want}


@pytest.mark.parametrize("kind", ["int", "long"])
def test_merges_only_rename_clusters(spark, kind):
    from netloom.operators import blocked

    rows = [(i, float(c * 10 + i % 7), c) for c, n in enumerate((1, 2, 3, 30, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, f"node_id long, x double, label {kind}")
    out = curate.merge_until(df, ["x"], at_most=2, force=True)
    # 0 joins 1, both join 2, all these join 3.
    assert sorted((r["label"], r["count"]) for r in out.groupBy("label").count().collect()) == [(0, 36), (1, 40)]
    few, many = (blocked.written(df, "p").transform(lambda d: curate._renamed(d, "label", {i: 4 for i in range(n)}))._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (1, 4))
    assert few == many


@pytest.mark.parametrize("most", [0, 100_000])
def test_large_groups_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(preprocess, "GROUPS", most)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 3), float(1 + i % 5 + 10 * (i % 2))) for i in range(40)], "id int, g string, x double, y double")
    out = preprocess.transform(df, ["x", "y"], groups=["g"])
    rows = {r["id"]: r for r in out.collect()}
    for g in range(2):
        own = [i for i in range(40) if i % 2 == g]
        largest = max(1 + i % 5 + 10 * g for i in own)
        for i in own:
            x, y = np.log(i % 3 or largest / 1e5), np.log(1 + i % 5 + 10 * g)
            assert rows[i]["x"] == pytest.approx(x - (x + y) / 2) and rows[i]["y"] == pytest.approx(y - (x + y) / 2)
    if most:
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
