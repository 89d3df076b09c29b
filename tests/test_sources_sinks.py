import math

import pytest
from pyspark.sql import functions as F

from langshift.config import PRESETS, feature_table_name, result_name, slice_tables
from langshift.functions.columns import float_text, is_finite, rounded
from langshift.plans.export import export_result
from langshift.sources import sinks
from langshift.sources.tables import read_features, read_table, read_trust_scores, tag_slices


def lines(spark, path):
    return sorted(row.value for row in spark.read.text(path).collect())


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("x", 0.2), ("y", -0.05), ("w", 0.0), ("v", math.nan), ("u", None)], "feat string, score double")


@pytest.mark.parametrize("threshold, kept", [(0.0, {"x", "y"}), (0.05, {"x"}), (0.2, set())])
def test_strict_threshold(scores, threshold, kept):
    assert {row.feat for row in sinks.above_threshold(scores, "score", threshold).collect()} == kept


def test_line_formats(spark, scores, tmp_path):
    sinks.write_lines(sinks.score_lines(scores, "feat", "score", 0.05), str(tmp_path / "a"))
    assert lines(spark, str(tmp_path / "a")) == ["x\t,\t0.2"]
    vector = spark.createDataFrame([("x", 1.0, 2.0)], "feat string, p double, q double")
    sinks.write_lines(sinks.vector_lines(vector, "feat", ["p", "q"]), str(tmp_path / "b"))
    assert lines(spark, str(tmp_path / "b")) == ["x\t:\t1.0\t2.0\t"]
    sinks.write_lines(sinks.list_lines(scores, "feat"), str(tmp_path / "c"))
    assert lines(spark, str(tmp_path / "c")) == ["u", "v", "w", "x", "y"]


def test_float_text_is_the_usual_notation(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.001, 0.0001, -0.00012345, 0.00001, -1.5e-7, 1e7, 12345678.5, -98765432.0, 1e15, 1.5e16, -1e22, 1e-300, 3e100]
    frame = spark.createDataFrame([(value,) for value in values], "v double").select("v", float_text(F.col("v")).alias("text"))
    assert {row.v: row.text for row in frame.collect()} == {value: str(value) for value in values}


def test_column_helpers(spark):
    frame = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "v double")
    assert [row[0] for row in frame.select(is_finite(F.col("v"))).collect()] == [True, False, False, False, False]
    tiny = spark.createDataFrame([(-1e-9,)], "v double").select(rounded(F.col("v"))).first()[0]
    assert math.copysign(1, tiny) == 1


def test_names():
    assert slice_tables(1) == ("msg_1001_nrt_core_1", "msg_1001_nrt_core_2", "msg_1001_nrt_1st")
    assert slice_tables(2)[2] == "msg_1001_nrt_2nd" and slice_tables(0)[2] == slice_tables(7)[2] == "msg_1001_nrt"
    assert feature_table_name("m") == "feat$cat_met_a30_2000_cp_w$m$user_id$16to16"
    assert feature_table_name("m", "1to3gram", suffix="0_01") == "feat$1to3gram$m$user_id$16to16$0_01"
    flagship = PRESETS["minmax_population"].with_depth(2)
    assert [result_name(flagship, kind, 1) for _, kind, _ in flagship.sinks][:2] == ["norm_1_cs_23.csv", "norm_1_cs_r_23.csv"]
    assert result_name(PRESETS["trust"], "tr_cos_sims.csv") == "tr_cos_sims.csv"


def test_feature_tables(spark, tmp_path):
    schema = "id long, group_id long, feat string, value double, group_norm double"
    for number, table in enumerate(slice_tables(1)):
        rows = spark.createDataFrame([(1, number, "a", 1.0, 0.5)], schema)
        rows.write.parquet(str(tmp_path / feature_table_name(table)))
    features = read_features(spark, str(tmp_path), tercile=1)
    assert {(row.slice, row.group_id) for row in features.collect()} == {(0, 0), (1, 1), (2, 2)}
    with pytest.raises(ValueError):
        tag_slices(features.drop("group_norm"))


def test_other_formats_and_required_columns(spark, tmp_path):
    table = spark.createDataFrame([(1, 3)], "user_id long, num_of_friends long")
    table.write.orc(str(tmp_path / "scores"))
    assert read_table(spark, str(tmp_path / "scores"), "orc").count() == 1
    with pytest.raises(ValueError, match="diff_score"):
        read_trust_scores(spark, str(tmp_path / "scores"), "orc")


def test_append_and_table_like(spark, tmp_path):
    table = spark.createDataFrame([(1, "a")], "id long, name string")
    for _ in range(2):
        sinks.append_rows(table, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    empty = sinks.table_like(table, add={"position": "int", "parent_id": "string"}, drop=("name",))
    assert empty.dtypes == [("id", "bigint"), ("position", "int"), ("parent_id", "string")] and empty.count() == 0


def test_export_writes_every_result_of_a_variant(spark, tmp_path):
    cosines = spark.createDataFrame(
        [("a", 0.5, 0.2, 0.3), ("b", 0.5, 0.45, 0.05)], "feat string, cos_friends double, cos_base double, cos_diff double"
    )
    export_result(PRESETS["minmax_population"].with_depth(2), cosines, str(tmp_path), tercile=2)
    assert lines(spark, str(tmp_path / "norm_2_cs_dif_23.csv")) == ["a\t,\t0.3", "b\t,\t0.05"]
    assert lines(spark, str(tmp_path / "norm_2_cs_dif_02_23.csv")) == ["a\t,\t0.3"]
    fits = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 9)], "feat string, b_friends double, b_base double, intercept double, mae double, n long")
    export_result(PRESETS["ols_population"].with_depth(1), fits, str(tmp_path))
    assert lines(spark, str(tmp_path / "norm_0_params_12.csv")) == ["a\t:\t1.0\t2.0\t3.0\t4.0\t"]
    assert lines(spark, str(tmp_path / "norm_0_friends_param_12.csv")) == ["a\t,\t1.0"]
