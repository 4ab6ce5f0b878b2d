import pytest

from netloom import cohort
from netloom.sources import fixtures


@pytest.fixture
def folder(spark, tmp_path):
    for name, patient in (("high", "p_1"), ("low", "p2")):
        nodes, edges = fixtures.network(spark, name)
        frame = nodes.orderBy("node_id").toPandas()
        frame["kind"] = list(fixtures.NETWORKS[name][0])
        frame["m"] = range(len(frame))
        frame.drop(columns=["patient", "sample", "node_id"]).to_parquet(tmp_path / f"nodes_patient-{patient}_sample-{name}.parquet")
        edges.select("source", "target").toPandas().to_parquet(tmp_path / f"edges_patient-{patient}_sample-{name}.parquet")
    return str(tmp_path)


def test_network_stats(spark, folder, tmp_path):
    save = str(tmp_path / "out")
    rows = {r["sample"]: r for r in cohort.network_stats(spark, folder, "kind", n_shuffle=5, save=save).collect()}
    assert rows["high"]["assort"] == pytest.approx(1) and rows["low"]["assort"] == pytest.approx(-0.5) and rows["high"]["patient"] == "p_1"
    onehot = {r["sample"]: r for r in cohort.network_stats(spark, folder, ["a", "b", "c"], n_shuffle=5).collect()}
    assert onehot["low"]["b - a RAW"] == rows["low"]["b - a RAW"]
    again = cohort.network_stats(spark, folder, "kind", n_shuffle=5, save=save)
    assert {r["sample"] for r in again.collect()} == {"high", "low"}
    one = cohort.network_stats(spark, folder, "kind", index=[("p2", "low")], n_shuffle=5)
    assert one.count() == 1 and "% c" in one.columns


def test_spatial_features(spark, folder):
    rows = cohort.spatial_features(spark, folder, "kind", stats="mean").where("sample = 'high'").orderBy("node_id").collect()
    assert len(rows) == 12 and rows[1]["a mean"] == 1 and rows[0]["c mean"] == 0
    assert cohort.spatial_features(spark, folder, ["m"], order=2).columns == ["patient", "sample", "node_id", "m mean", "m std"]
    assert cohort.spatial_features(spark, folder, ["a", "b", "c"], method="smoothed", components=2).count() == 24
    with pytest.raises(ValueError):
        cohort.spatial_features(spark, folder, ["m"], method="other")


def test_node_tables(spark, folder, tmp_path):
    assert cohort.aggregate_nodes(spark, folder, ["m"]).columns == ["m", "patient", "sample"]
    assert cohort.aggregate_nodes(spark, folder, add_info=False).count() == 24
    out = cohort.transform_nodes(spark, folder, ["x", "y"], save=str(tmp_path / "t"))
    assert all(r["x"] + r["y"] == pytest.approx(0, abs=1e-9) for r in out.collect() if r["x"] is not None)
    nodes, _ = cohort.read(spark, folder)
    assert sorted(r["node_id"] for r in nodes.where("sample = 'low'").collect()) == list(range(12))
    fixed = cohort.batch_correct_nodes(spark, folder, ["x", "y"], node_id="m")
    assert fixed.count() == 24 and "kind" in fixed.columns


def test_saved_tables_know_all_their_parameters(spark, folder, tmp_path):
    save = str(tmp_path / "saved")
    made = [cohort.spatial_features(spark, folder, ["a", "b", "c"], method="smoothed", components=k, save=save).first()["features"] for k in (2, 3)]
    assert [len(v) for v in made] == [2, 3]
    by = {k: cohort.batch_correct_nodes(spark, folder, ["x", "y"], node_id=k, save=save).count() for k in ("m",)}
    assert by == {"m": 24}
    both = [cohort.network_stats(spark, folder, "kind", levels=levels, n_shuffle=2, save=save).count() for levels in (("patient", "sample"), ("patient",))]
    assert both[0] == 2 and both[1] >= 1
