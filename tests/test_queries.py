"""Queries against their SQL twins, and what the plans must not contain."""

import contextlib
import io
import math
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from langshift.fixtures import Fixture
from langshift.oracle import PREPARATION_QUERIES
from langshift.queries import QUERIES

TABLES = ("customer", "orders", "lineitem", "part")
CHECKED = [
    *PREPARATION_QUERIES,
    "users_all", "users_loaded_set", "user_set_sizes", "followers_bucketed", "users_core", "users_loaded", "users_periphery", "user_index", "edges_core", "edges_capped",
    "random_people", "features_loaded", "features_by_tercile", "features_minmax_norm", "topic_dictionary",
    "slice_topic_stats", "topic_deltas", "topic_influence", "topic_influence_trust", "topic_ols",
    "ols_export_lines", "influence_above_threshold", "pipeline_counts", "trust_diffs", "topic_influence_order_free",
    "slice_topic_stats_order_free",
]


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list:
    def plain(value):
        missing = value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value))
        return None if missing else value

    names = sorted(frame.columns)
    return sorted((tuple(plain(value) for value in row) for row in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, folder, name):
    actual = entry_module.queries()[name](spark, folder).toPandas()
    expected = duck.execute(entry_module.oracle_sql()[name]).df()
    assert sorted(actual.columns) == sorted(expected.columns)
    assert canonical(actual) == canonical(expected)
    assert len(actual) > 0 or name in ("unknown_topics",)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan_of(frame) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as printed:
        frame.explain("formatted")
    return printed.getvalue()


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")


@pytest.mark.parametrize(
    "name", ["topic_influence", "topic_influence_random", "topic_influence_order_free", "topic_deltas", "friend_messages", "message_positions", "message_parts"]
)
def test_plan_has_no_forbidden_step(spark, folder, name):
    plan = plan_of(QUERIES[name](Fixture(spark, folder)))
    assert not [step for step in FORBIDDEN if step in plan]


@pytest.mark.parametrize("name", ["message_parts", "first_tercile_messages", "friend_messages"])
def test_messages_never_meet_in_one_task(spark, folder, name):
    plan = plan_of(QUERIES[name](Fixture(spark, folder)))
    assert "SinglePartition" not in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(QUERIES["user_first_messages"](Fixture(spark, folder)))
    assert "EqualTo(o_custkey,7)" in re.search(r"PushedFilters: (.*)", plan).group(1)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES["network_core"](Fixture(spark, folder))))
    assert "l_orderkey:bigint,l_partkey:bigint" in scans
    assert not any("l_extendedprice" in scan or "o_totalprice" in scan for scan in scans)


@pytest.mark.parametrize("name", ["edges_core", "user_set_sizes", "trust_diffs"])
def test_queries_of_edges_write_no_features(spark, tmp_path, name):
    """The tables of features, the dearest inputs, are left alone: the folder has no parts to derive them from."""
    for table in ("customer", "orders", "lineitem"):
        (tmp_path / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    assert QUERIES[name](Fixture(spark, str(tmp_path))).count() > 0


def test_order_lines_are_not_sorted_for_their_joins(spark, folder):
    for frame in (Fixture(spark, folder).network, Fixture(spark, folder).features()):
        plan = plan_of(frame)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
