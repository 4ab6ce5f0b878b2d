import pytest
from pyspark.sql import functions as F

from netloom.model import checked, class_sets, label_sets
from netloom.operators import assort
from netloom.sources import fixtures

K = ("patient", "sample")
COUNTS = {
    "triangle": [0, 1, 0, 1, 1, 0], "trigonal": [1, 1, 1, 1, 1, 1], "p": [0, 0, 0, 1, 2, 3], "high": [3, 0, 3, 0, 0, 3], "low": [0, 4, 0, 4, 4, 0],
}
COEFFICIENT = {"triangle": -0.5, "trigonal": 0.25, "p": -7 / 29, "high": 1.0, "low": -0.5}


def labels_of(nodes):
    return label_sets(nodes, ["a", "b", "c"], K)


@pytest.mark.parametrize("name", COUNTS)
def test_known_networks(spark, name):
    nodes, edges = fixtures.network(spark, name)
    raw = assort.mixing_matrix(labels_of(nodes), edges, 3, K, normalized=False, double_diag=False)
    assert [r["value"] for r in assort.to_columns(raw, K).orderBy("position").collect()] == COUNTS[name]
    matrix = assort.mixing_matrix(labels_of(nodes), edges, 3, K)
    assert matrix.agg(F.sum("value")).first()[0] == pytest.approx(1)
    assert assort.assortativity(matrix, K).first()["assort"] == pytest.approx(COEFFICIENT[name], abs=1e-12)


def test_cohort_equals_single_networks(spark):
    nodes, edges = fixtures.cohort(spark, list(COUNTS))
    found = assort.assortativity(assort.mixing_matrix(labels_of(nodes), edges, 3, K), K)
    assert {r["sample"]: r["assort"] for r in found.collect()} == pytest.approx(COEFFICIENT)


def test_multilabel_loops_and_repeats(spark):
    nodes = spark.createDataFrame([("0", "s", 0, True, True), ("0", "s", 1, True, True), ("0", "s", 2, False, None)], "patient string, sample string, node_id long, a boolean, b boolean")
    edges = spark.createDataFrame([("0", "s", s, t) for s, t in ((0, 1), (0, 1), (1, 1), (2, 0))], "patient string, sample string, source long, target long")
    got = {(r["i"], r["j"]): r["n"] for r in assort.pair_counts(label_sets(nodes, ["a", "b"], K), edges, K).collect()}
    assert got == {(0, 0): 3, (1, 0): 3, (1, 1): 3}
    directed = {(r["i"], r["j"]): r["n"] for r in assort.pair_counts(label_sets(nodes, ["a", "b"], K), edges, K, directed=True).collect()}
    assert directed == {(0, 0): 3, (0, 1): 3, (1, 0): 3, (1, 1): 3}
    assert assort.count_edges(label_sets(nodes, ["a", "b"], K), edges, 0, 1, K).first()["n"] == 3


def test_no_edges_and_one_class(spark):
    nodes, edges = fixtures.network(spark, "p")
    none = assort.mixing_matrix(labels_of(nodes), edges.where("false"), 3, K)
    assert none.where("value is not null").count() == 0
    assert assort.assortativity(none, K).first()["assort"] is None
    one = nodes.withColumns({"a": F.lit(1), "b": F.lit(0), "c": F.lit(0)})
    assert assort.assortativity(assort.mixing_matrix(labels_of(one), edges, 3, K), K).first()["assort"] is None


def test_missing_attribute_is_zero(spark):
    nodes, edges = fixtures.network(spark, "p")
    raw = assort.mixing_matrix(label_sets(nodes, ["a", "c", "zz"], K), edges, 3, K, normalized=False)
    assert {r["value"] for r in raw.where("i = 2").collect()} == {0.0}


def test_randomized_keep_totals_and_repeat(spark):
    nodes, edges = fixtures.network(spark, "low")
    runs = [sorted(map(tuple, assort.randomized_counts(labels_of(nodes).repartition(n), edges, 20, K).collect())) for n in (1, 3)]
    assert runs[0] == runs[1]
    totals = assort.randomized_counts(labels_of(nodes), edges, 20, K).groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert len(totals) == 20 and {r["n"] for r in totals} == {12}
    shuffled = assort.randomized(labels_of(nodes), 20, K).select(F.posexplode("shuffled").alias("k", "l")).groupBy("k", "l").count()
    assert {r["count"] for r in shuffled.collect()} == {4}


def test_large_networks_are_ranked_in_slices(spark, monkeypatch):
    from netloom.functions import ranks

    nodes, _ = fixtures.network(spark, "low")
    one = sorted(map(str, assort.randomized(labels_of(nodes), 9, K).collect()))
    monkeypatch.setattr(ranks, "LARGE", 3)
    assert sorted(map(str, assort.randomized(labels_of(nodes), 9, K).collect())) == one


def test_permutations_are_never_broadcast(spark, monkeypatch):
    """Arrays of permutations are far longer than Spark's estimates, which once broadcast them."""
    from netloom.functions import ranks

    nodes = spark.createDataFrame([("0", s, v, v % 2 == 0, v % 3 == 0, v == 5) for s in "st" for v in range(9)], "patient string, sample string, node_id long, a boolean, b boolean, c boolean")
    edges = spark.createDataFrame([("0", s, a, b) for s in "st" for a, b in ((0, 1), (1, 2), (2, 3), (3, 0), (5, 5), (5, 6), (5, 6), (8, 99))], "patient string, sample string, source long, target long")
    counts = assort.randomized_counts(labels_of(nodes), edges, 7, K)
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    one = sorted(map(tuple, counts.collect()))
    ends = assort._ends(assort.randomized(labels_of(nodes), 7, K), edges, K, wide=True)
    assert "Broadcast" not in ends._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, assort._counted_sliced(labels_of(nodes), edges, 7, K).collect())) == one
    for name, module in (("LARGE", ranks), ("LINKS", assort)):
        with monkeypatch.context() as m:
            m.setattr(module, name, 3)
            assert sorted(map(tuple, assort.randomized_counts(labels_of(nodes), edges, 7, K).collect())) == one
    monkeypatch.setattr(assort, "HELD", 16)
    assert sorted(map(tuple, assort.randomized_counts(labels_of(nodes), edges, 7, K).collect())) == one


def test_sample_stats_columns(spark):
    nodes, edges = fixtures.cohort(spark)
    row = {r["sample"]: r.asDict() for r in assort.sample_stats(nodes, edges, ["a", "b", "c"], K, 10).collect()}["high"]
    assert row["# total"] == 12 and row["% a"] == pytest.approx(1 / 3) and row["assort"] == pytest.approx(1)
    assert row["b - a RAW"] == 0 and row["assort Z"] > 1 and {"c - c MEAN", "c - c STD", "c - c Z"} <= row.keys()


def test_select_edges(spark):
    edges = spark.createDataFrame([("0", "s", s, t) for s, t in ((1, 2), (3, 4), (5, 6), (7, 8))], "patient string, sample string, source long, target long")
    ids = spark.createDataFrame([("0", "s", i) for i in (5, 6, 7)], "patient string, sample string, node_id long")
    pairs = lambda how: sorted((r["source"], r["target"]) for r in assort.select_edges(ids, edges, how, K).collect())
    assert pairs("inner") == [(5, 6)] and pairs("outer") == [(5, 6), (7, 8)]
    with pytest.raises(ValueError):
        assort.select_edges(ids, edges, "some", K)


def test_names_round_trip(spark):
    assert assort.pair_name(["a", "b"]) == ["a - a", "b - a", "b - b"]
    series = spark.createDataFrame([("0", "s", "a - a Z", 1.0), ("0", "s", "b - a Z", 2.0)], "patient string, sample string, name string, value double")
    assert sorted((r["a"], r["b"], r["value"]) for r in assort.from_named(series, K).collect()) == [("a", "a", 1.0), ("a", "b", 2.0), ("b", "a", 2.0)]


def test_orphans_raise(spark):
    nodes, edges = fixtures.network(spark, "p")
    assert checked(nodes, edges) is edges
    with pytest.raises(ValueError):
        checked(nodes.where("node_id < 5"), edges)


def test_class_sets(spark):
    nodes = spark.createDataFrame([("0", "s", 0, "x"), ("0", "s", 1, "?"), ("0", "s", 2, None)], "patient string, sample string, node_id long, kind string")
    assert [r["labels"] for r in class_sets(nodes, "kind", ["x"], K).orderBy("node_id").collect()] == [[0], [], []]
