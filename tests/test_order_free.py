"""Sums, statistics and cosines that do not depend on how rows are dealt and ordered."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from langshift.config import PRESETS
from langshift.operators.order_free import order_free_sum, unit_scale
from langshift.plans.order_free import OrderFree
from langshift.plans.study import Study
from study_data import Dense, Inputs, assert_close, by_topic, random_inputs


def summed(rows, bits=0):
    return rows.agg(order_free_sum(F.col("v"), bits).alias("s")).first()["s"]


def test_sums_are_exact_and_alike(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.uniform(-1, 1, 3000) * 2.0 ** rng.integers(-30, 1, 3000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    found = {summed(rows.repartition(n).orderBy(F.rand(n))) for n in (1, 7, 200)}
    assert len(found) == 1 and found.pop() == pytest.approx(math.fsum(values), rel=1e-15)
    assert len({float(np.cumsum(order)[-1]) for order in (values, sorted(values), sorted(values, key=abs))}) > 1
    assert summed(rows.where("v is null")) is None


@pytest.mark.parametrize("values, bits", [([-1e-30, 0.25], 0), ([1.0, -1.0], 0), ([3.5, -2.0, 0.1], 2), ([0.0, -0.0], 0), ([2.0**-90, -1.0, 1.0], 0)])
def test_sums_of_odd_values(spark, values, bits):
    assert summed(spark.createDataFrame([(v,) for v in values], "v double"), bits) == pytest.approx(math.fsum(values), abs=2.0**-89)


def test_scale(spark):
    sizes = [1.0, 0.5, 0.3, 5.0, 2.0**29, 1e-320, 1e300, 0.0, None]
    rows = spark.createDataFrame([(v,) for v in sizes], "v double").select("v", unit_scale(F.col("v")).alias("s")).collect()
    for row in rows:
        assert math.frexp(row["s"])[0] == 0.5
        if row["v"] and row["v"] > 1e-300:
            assert 0.5 - 1e-9 <= row["v"] * row["s"] <= 1 + 1e-9
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(bad,)], "v double").select(unit_scale(F.col("v"))).collect()


def order_free(spark, inputs, variant="minmax_population", **options):
    return OrderFree(Study(*inputs.frames(spark), PRESETS[variant].but(min_degree=5), **options))


def test_equals_dense(spark):
    inputs = random_inputs(1)
    dense, found = Dense(inputs, 5), order_free(spark, inputs)
    assert_close(by_topic(found.cosines, "cos_friends", "cos_base"), dense.cosines(method="minmax"))
    plain = Study(*inputs.frames(spark), PRESETS["minmax_population"].but(min_degree=5)).statistics
    names = [f"{name}{number}" for number in range(3) for name in ("rows", "mean", "var", "min", "max")]
    assert_close(by_topic(found.statistics, *names), by_topic(plain, *names), 1e-14)


@pytest.mark.parametrize("variant", ["raw_population", "capped_random"])
def test_other_variants_equal_the_study(spark, variant):
    inputs = random_inputs(2)
    plain = Study(*inputs.frames(spark), PRESETS[variant].but(min_degree=5)).cosines
    names = ("cos_friends", "cos_base", "cos_diff")
    assert_close(by_topic(order_free(spark, inputs, variant).cosines, *names), by_topic(plain, *names), 1e-12)


def test_topics_of_any_size(spark):
    """One topic a billion times as large as another: each has places of its own."""
    inputs = random_inputs(3)
    factor = {"t0": 1e9, "t1": 1e-9}
    sized = Inputs(inputs.users, inputs.network, [(s, i, u, f, v, x * factor.get(f, 1.0)) for s, i, u, f, v, x in inputs.features])
    assert_close(by_topic(order_free(spark, sized).cosines, "cos_friends", "cos_base"), Dense(sized, 5).cosines(method="minmax"))


def test_no_bit_depends_on_partitions(spark):
    inputs = random_inputs(4)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, map_side_bytes in ((1, 64 << 20), (7, 0), (40, 2000)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            frames = [frame.repartition(partitions).orderBy(F.rand(partitions)) for frame in inputs.frames(spark)]
            found = OrderFree(Study(*frames, PRESETS["minmax_population"].but(min_degree=5), map_side_bytes=map_side_bytes))
            seen.append((sorted(found.cosines.collect()), sorted(found.statistics.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_nobody(spark):
    empty = Inputs([], [], [])
    assert order_free(spark, empty).cosines.count() == 0
    assert order_free(spark, empty).statistics.count() == 0
