import datetime

import pytest
from pyspark.sql import functions as F

from netloom.sources import fixtures, io
from netloom.streaming import sessions


@pytest.mark.parametrize("extension", ["parquet", "csv"])
def test_file_pairs(spark, tmp_path, extension):
    import pandas as pd

    for patient, sample, n in (("p1", "s_1", 2), ("p_2", "s2", 3)):
        frame = pd.DataFrame({"x": range(n), "y": [0.5] * n})
        path = tmp_path / f"nodes_patient-{patient}_sample-{sample}.{extension}"
        frame.to_parquet(path) if extension == "parquet" else frame.to_csv(path, index=False)
    table = io.read_files(spark, str(tmp_path), "nodes", extension=extension)
    assert {(r["patient"], r["sample"]) for r in io.networks(table).collect()} == {("p1", "s_1"), ("p_2", "s2")}
    assert io.read_files(spark, str(tmp_path), "nodes", extension=extension, index=[("p_2", "s2")]).count() == 3
    with pytest.raises(ValueError):
        io.read_files(spark, str(tmp_path), "nodes", extension="orc")


def test_single_level_and_missing_columns(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"x": [1]}).to_parquet(tmp_path / "nodes_patient-a_b.parquet")
    pd.DataFrame({"x": [2], "z": [3.0]}).to_parquet(tmp_path / "nodes_patient-c.parquet")
    rows = {r["patient"]: r["z"] for r in io.read_files(spark, str(tmp_path), "nodes", ["patient"]).collect()}
    assert rows == {"a_b": None, "c": 3.0}


def test_cohort_round_trip(spark, tmp_path):
    nodes, _ = fixtures.cohort(spark)
    for extension in io.FORMATS:
        path = str(tmp_path / extension)
        io.write_cohort(nodes, path, extension=extension)
        back = io.read_cohort(spark, path, extension=extension)
        assert back.where("sample = 'low'").count() == 12 and back.schema["patient"].dataType.simpleString() == "string"


def test_cohort_of_many_networks_is_few_files(spark, tmp_path):
    nodes = spark.range(3000).selectExpr("lpad(id % 1000, 4, '0') AS patient", "'a' AS sample", "id AS node_id", "id / 2 AS x")
    path = tmp_path / "many"
    io.write_cohort(nodes, str(path))
    assert len(list(path.rglob("*.parquet"))) <= 8
    back = io.read_cohort(spark, str(path))
    assert back.exceptAll(nodes.select(*back.columns)).isEmpty() and back.count() == 3000
    assert sorted(r["node_id"] for r in back.where("patient = '0007'").collect()) == [7, 1007, 2007]
    nodes.limit(20).write.partitionBy("patient", "sample").parquet(str(tmp_path / "folders"))
    assert io.read_cohort(spark, str(tmp_path / "folders")).count() == 20


def test_cached(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = io.keyed(str(tmp_path), "t", {"a": 1})
    assert path != io.keyed(str(tmp_path), "t", {"a": 2})
    for again in (False, False, True):
        assert io.cached(spark, path, compute, again).count() == 3
    assert len(calls) == 2


def test_matrix(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert [tuple(r) for r in io.read_matrix(spark, str(tmp_path / "m.csv"), ["a", "b"]).collect()] == [(1.0, 2.0), (3.0, 4.0)]


def test_random_network(spark):
    nodes, edges = fixtures.random_network(spark, 60, 0.2, seed=4)
    assert nodes.count() == 60 and 200 < edges.count() < 520 and edges.where("source >= target").count() == 0
    assert nodes.where(F.col("a") + F.col("b") + F.col("c") != 1).count() == 0
    multi, _ = fixtures.random_network(spark, 60, 0.2, multi=True)
    assert dict(multi.dtypes)["a"] == "boolean"


def test_sessions_of_a_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    rows = [(1, at(0), 7, "view", 1.0), (2, at(10), 7, "click", 2.0), (3, at(100), 7, "view", 3.0), (4, at(5), 8, "view", 4.0), (5, at(5000), 9, "view", 5.0)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(6, at(9000), 9, "view", 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = []

    def each(batch, _):
        nodes, edges = sessions.session_networks(batch)
        found.extend((r["user_id"], r["source"], r["target"]) for r in edges.collect())
        found.extend((r["user_id"], r["node_id"]) for r in nodes.collect())

    schema = spark.read.parquet(str(tmp_path / "in")).schema
    sessions.stream(spark, str(tmp_path / "in"), schema, each, str(tmp_path / "check"), pattern="*.parquet").awaitTermination()
    assert (7, 1, 2) in found and {(7, 3), (8, 4), (7, 1), (7, 2)} <= set(found)


def test_an_index_opens_only_its_files(spark, tmp_path):
    for k in ("a", "b_1", "c[x]"):
        spark.createDataFrame([(k,)], "v string").toPandas().to_parquet(tmp_path / f"nodes_patient-{k}_sample-s.parquet")
    got = io.read_files(spark, str(tmp_path), "nodes", index=[("b_1", "s"), ("c[x]", "s"), ("none", "s")])
    assert {r["v"] for r in got.collect()} == {"b_1", "c[x]"} and len(got.inputFiles()) == 2
    assert io.read_files(spark, str(tmp_path), "nodes", index=[("none", "s")]).count() == 0


def test_scratch_off_local_masters():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.scratch(Session, "x")
