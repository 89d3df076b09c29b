"""Inputs that are written side by side, and cells of all slices from one pass."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from langshift.config import PRESETS
from langshift.operators.storage import materialise, stage_tables, together
from langshift.plans.order_free import OrderFree
from langshift.plans.study import Study
from study_data import assert_close, by_topic, random_inputs


def test_features_and_edges_are_written_at_the_same_time(spark):
    users, network, features = random_inputs(3).frames(spark)
    both = threading.Barrier(2, timeout=60)

    def waiting(frame):
        return lambda: (both.wait(), frame)[1]

    study = Study(users, waiting(network), waiting(features), PRESETS["minmax_population"].but(min_degree=5))
    plain = Study(users, network, features, PRESETS["minmax_population"].but(min_degree=5))
    names = ("cos_friends", "cos_base")
    assert_close(by_topic(study.cosines, *names), by_topic(plain.cosines, *names))


def test_accounts_are_asked_for_when_needed(spark):
    accounts = spark.createDataFrame([(1, 1, 300, 30), (2, 3, 300, 30)], "id long, level int, statuses_count long, recorded_friends_count long")
    asked = []
    study = Study.of_accounts(lambda: asked.append(1) or accounts, None, None, PRESETS["minmax_population"])
    assert not asked
    assert {(row.id, row.is_core) for row in study.users.collect()} == {(1, True), (2, False)} and asked == [1]


def test_one_stage_table_of_cells(spark):
    users, network, features = random_inputs(4).frames(spark)
    study = Study(users, network, features, PRESETS["minmax_population"].but(min_degree=5))
    core, reference = study.core_cells, study.reference_cells
    assert core.inputFiles() and set(core.inputFiles()) == set(reference.inputFiles())
    core_ids = study.users.where("is_core").select(F.col("id").alias("group_id"))
    rows = features.join(core_ids, "group_id", "left_semi").where("slice < 2").select("group_id", "feat").distinct()
    assert sorted(core.select("group_id", "feat").collect()) == sorted(rows.collect())
    loaded = study.loaded.select(F.col("id").alias("group_id"))
    rows = features.join(loaded, "group_id", "left_semi").where("slice = 2").select("group_id", "feat").distinct()
    assert sorted(reference.select("group_id", "feat").collect()) == sorted(rows.collect())


def test_steps_keep_the_stage_tables_block_and_fail_as_one(spark):
    with stage_tables(spark) as paths:
        together(*(lambda name=name: materialise(spark.range(3), name) for name in ("a", "b")))
        assert len(paths) == 2 and all(Path(path).exists() for path in paths)
    assert not any(Path(path).exists() for path in paths)
    with pytest.raises(ZeroDivisionError):
        together(lambda: spark.range(1), lambda: 1 / 0)


def test_order_free_cosines_keep_their_bits(spark):
    users, network, features = random_inputs(5).frames(spark)
    variant = PRESETS["minmax_population"].but(min_degree=5)
    plain, called = Study(users, network, features, variant), Study(lambda: users, lambda: network, lambda: features.repartition(5), variant)
    assert sorted(OrderFree(called).cosines.collect()) == sorted(OrderFree(plain).cosines.collect())
