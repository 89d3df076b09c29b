"""Reference scores packed as vectors where topics are well filled, as lists elsewhere: the same sums."""

import numpy as np
import pytest

from langshift.config import PRESETS
from langshift.operators import influence as influence_ops
from langshift.plans.order_free import OrderFree
from langshift.plans.study import Study
from study_data import Dense, Inputs, assert_close, by_topic, random_inputs

COSINES = ("cos_friends", "cos_base")


def make(spark, inputs, variant="minmax_population", **options):
    return Study(*inputs.frames(spark), PRESETS[variant].but(min_degree=5), **options)


def test_a_link_moves_one_vector_and_is_added_up_whole(spark):
    study = make(spark, random_inputs(11), map_side_bytes=0)
    _, light = study._packed
    assert light.columns == ["dest_id", "block", "vector"] and light.count() == light.select("dest_id", "block").distinct().count()
    plan = study.friend_averages._jdf.queryExecution().optimizedPlan().toString()
    unpacked = plan.split("Generate explode(")[1]
    assert unpacked.index("Aggregate [id") < unpacked.index("Join Inner")


@pytest.mark.parametrize("variant", ["minmax_population", "capped_random"])
def test_vectors_and_lists_agree(spark, monkeypatch, variant):
    """Several blocks of two topics, some people's scores copied to every task."""
    inputs = random_inputs(12)
    monkeypatch.setattr(influence_ops, "VECTOR_BITS", 1)
    vectors = make(spark, inputs, variant, map_side_bytes=2500)
    assert None not in vectors._packed and vectors._packed[1].select("block").distinct().count() > 1
    found, exact = by_topic(vectors.cosines, *COSINES), OrderFree(make(spark, inputs, variant, map_side_bytes=2500)).cosines.collect()
    monkeypatch.setattr(influence_ops, "VECTOR_FILL", 2.0)
    lists = make(spark, inputs, variant)
    assert "scores" in lists._packed[0].columns
    assert_close(found, by_topic(lists.cosines, *COSINES), 1e-12)
    assert sorted(exact) == sorted(OrderFree(make(spark, inputs, variant)).cosines.collect())


def test_sparse_topics_stay_lists(spark):
    """Sixty topics of which a user has about three."""
    inputs, rng = random_inputs(13), np.random.default_rng(13)
    cells = [(s, user, int(topic)) for s in range(3) for user in range(30) for topic in rng.choice(60, 3, replace=False)]
    sparse = Inputs(inputs.users, inputs.network, [(s, i, u, f"t{t}", 1.0, float(rng.random())) for i, (s, u, t) in enumerate(cells)])
    study = make(spark, sparse)
    assert "scores" in study._packed[0].columns
    assert_close(by_topic(study.cosines, *COSINES), Dense(sparse, 5).cosines())


def test_absent_and_zero_scores_are_told_apart(spark):
    """A place without a row makes no cell, a score of zero makes one."""
    cells = spark.createDataFrame([(1, 0, 0.0), (1, 2, 0.5), (2, 33, 0.25)], "group_id long, topic long, s2 double")
    links = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.5), (8, 1, 1.0)], "source_id long, dest_id long, friend_share double")
    packed = influence_ops.packed_vectors(cells, 3)
    rows = influence_ops.neighbour_sums(links, None, packed, ["friend_share"])
    found = influence_ops.topic_averages(rows, "friend_share", "friend_avg").orderBy("id", "topic").collect()
    assert [tuple(row) for row in found] == [(7, 0, 0.0), (7, 2, 0.25), (7, 33, 0.125), (8, 0, 0.0), (8, 2, 0.5)]
