import pytest

from langshift.config import PRESETS
from langshift.plans.export import export_study
from langshift.plans.study import Study
from langshift.sources import schema
from langshift.sources.tables import feature_source, read_accounts, read_features, read_network
from study_data import HAND


def test_text_ids_become_numbers(spark, tmp_path):
    rows = [("10", "9", "x"), ("9", None, "y")]
    spark.createDataFrame(rows, "source_id string, dest_id string, note string").write.parquet(f"{tmp_path}/network")
    network = read_network(spark, f"{tmp_path}/network")
    assert [field.dataType.simpleString() for field in network.schema.fields] == ["bigint", "bigint", "string"]
    assert [row.source_id for row in network.orderBy("source_id").collect()] == [9, 10]


def test_what_is_no_number_is_an_error(spark, tmp_path):
    spark.createDataFrame([("u1", "3")], "id string, level string").write.parquet(f"{tmp_path}/accounts")
    with pytest.raises(Exception, match="column id is not a long: u1"):
        read_accounts(spark, f"{tmp_path}/accounts").collect()
    with pytest.raises(ValueError, match="missing columns: dest_id, source_id"):
        read_network(spark, f"{tmp_path}/accounts")


def test_typed_tables_are_left_alone(spark):
    table = spark.createDataFrame([(1, 2)], "source_id long, dest_id long")
    assert schema.conform(table, schema.NETWORK) is table


def test_feature_tables_of_a_folder_and_of_a_database(spark, tmp_path):
    assert feature_source("/data", "feat$a", "parquet", {}) == {"location": "/data/feat$a", "fmt": "parquet"}
    options = {"url": "jdbc:x", "quote": '"', "fetchsize": "1000"}
    assert feature_source(None, "feat$a", "jdbc", options) == {
        "fmt": "jdbc", "dbtable": '"feat$a"', "url": "jdbc:x", "fetchsize": "1000",
    }
    rows = [("1", "5", "a", 1.0, 0.5)]
    for name in ("msg_1001_nrt_core_1", "msg_1001_nrt_core_2", "msg_1001_nrt"):
        frame = spark.createDataFrame(rows, "id string, group_id string, feat string, value double, group_norm double")
        frame.write.json(f"{tmp_path}/feat$t${name}$user_id$16to16")
    read = read_features(spark, str(tmp_path), topics="t", fmt="json", options={"primitivesAsString": "true"})
    assert sorted((row.slice, row.group_id, row.group_norm) for row in read.collect()) == [(0, 5, 0.5), (1, 5, 0.5), (2, 5, 0.5)]


def test_export_of_a_whole_study(spark, tmp_path):
    study = Study(*HAND.frames(spark), PRESETS["minmax_population"].but(min_degree=2))
    paths = export_study(study, str(tmp_path))
    assert len(paths) == len(PRESETS["minmax_population"].sinks)
    lines = sorted(row.value for row in spark.read.text(paths[0]).collect())
    assert [line.split("\t")[0] for line in lines] == ["a", "b"]
    params = export_study(Study(*HAND.frames(spark), PRESETS["ols_population"].but(min_degree=2)), f"{tmp_path}/ols")
    assert spark.read.text(params[0]).count() == 2
