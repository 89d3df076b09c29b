import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from langshift.operators import idsets, influence, insert, last_messages, network, positioned, prep
from langshift.operators.storage import materialise, stage_tables
from langshift.sources import sinks
from langshift.sources.bucketed import bucketed

EDGES = (0, -1, 1, 32_767, 32_768, 32_769, -32_767, -32_768, -32_769, 2**63 - 1, -(2**63) + 1, -(2**63))


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v long").repartition(3)


def test_bitmap_sets_equal_python_sets(spark):
    draw = random.Random(4)
    first = [*EDGES, None, *(draw.randrange(-50_000, 200_000) for _ in range(3000))]
    second = [*EDGES[:4], None, *(draw.randrange(0, 300_000) for _ in range(3000))]
    a, b = (idsets.id_set(ids(spark, [*values, *values[:50]]), "v") for values in (first, second))
    want_a, want_b = set(first) - {None}, set(second) - {None}
    assert {r["id"] for r in idsets.members(a).collect()} == want_a
    found = spark.range(1).select(idsets.size(a), idsets.size(idsets.union(a, b)), idsets.overlap(a, b)).first()
    assert tuple(found) == (len(want_a), len(want_a | want_b), len(want_a & want_b))
    assert idsets.members(idsets.union(a, b)).count() == len(want_a | want_b)


def test_empty_and_sparse_sets(spark):
    none = idsets.id_set(ids(spark, []), "v")
    assert tuple(spark.range(1).select(idsets.size(none), idsets.overlap(none, none)).first()) == (0, 0)
    assert idsets.is_dense(spark.range(5000).withColumnRenamed("id", "v"), "v")
    assert not idsets.is_dense(ids(spark, [i * 10**9 for i in range(200)]), "v")


def test_reach_by_bitmaps_equals_reach_by_distinct(spark, monkeypatch):
    draw = random.Random(6)
    network_ = spark.createDataFrame([(draw.randrange(-5, 60), draw.randrange(-900, 3000)) for _ in range(4000)], "source_id long, dest_id long")
    accounts = spark.createDataFrame([(i, i + 5) for i in range(-800, 2500)] + [(3, 9), (None, 4)], "id long, counter long")
    counts = []
    for dense in (True, False):
        monkeypatch.setattr(idsets, "is_dense", lambda rows, column, dense=dense: dense)
        counts.append(prep.ring_reach_count(network_, accounts).first()["reached"])
    assert counts[0] == counts[1] > 0


def messages(draw, n):
    return [(draw.choice([None, -3, 7, 8, 9]), draw.choice([None, draw.randrange(1000)]), draw.choice([None, draw.randrange(50)])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_batches_give_the_last_messages_of_all(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = messages(draw, 60)
    schema = "user_id long, message_id long, created_at long"
    cuts = sorted(draw.sample(range(1, 59), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 60])]
    draw.shuffle(batches)  # late batches
    batches.insert(2, batches[0])  # and one that comes twice
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    for batch in batches[:2]:
        last_messages.add_messages(spark.createDataFrame(batch, schema), first)
    last_messages.compact(spark, first, second)
    for batch in [*batches[2:], []]:
        last_messages.add_messages(spark.createDataFrame(batch, schema), second)
    got = sorted(map(tuple, last_messages.read_last(spark, second).collect()))
    assert got == sorted(map(tuple, last_messages.last_of(spark.createDataFrame(rows, schema)).collect()))
    assert spark.read.parquet(second).count() < len(rows)


@pytest.mark.parametrize("filter_bytes", [insert.FILTER_BYTES, 0])
def test_any_number_of_batches_keeps_the_first_row_of_a_key(spark, tmp_path, monkeypatch, filter_bytes):
    monkeypatch.setattr(insert, "FILTER_BYTES", filter_bytes)
    draw = random.Random(8)
    rows = [(i, draw.choice([None, *range(-20, 40)]), f"row {i}") for i in range(200)]
    schema = "counter long, id long, text string"
    want = {}
    for counter, key, text in rows:
        if key is not None:
            want.setdefault(key, (counter, key, text))
    for number, cuts in enumerate(([200], [1, 90, 200], [50, 50, 120, 200])):
        path = str(tmp_path / str(number))
        for at, (a, b) in enumerate(zip([0, *cuts], cuts)):
            batch = spark.createDataFrame(rows[a:b], schema).repartition(2)
            insert.insert_ignore(spark, batch, path, "id", "counter", exists=at > 0)
        got = [tuple(r) for r in spark.read.parquet(path).select("counter", "id", "text").collect()]
        assert sorted(got) == sorted(want.values())


def test_key_filter_lets_all_of_its_keys_through_and_few_others(spark):
    keys, others = spark.range(500).select("id"), spark.range(10_000, 30_000).select("id")
    condition = insert.key_filter(keys, "id", 500)
    assert keys.where(condition).count() == 500
    assert others.where(condition).count() < 20_000 * 0.05
    assert insert.key_filter(keys, "id", 10**12) is None


def test_bucketed_edges_are_not_moved(spark):
    """Core filter, degrees and last-message join by the bucketed end: only users and accounts are shuffled."""
    edges = spark.createDataFrame([(i % 50, i % 37) for i in range(600)] + [(1, 2)] * 20, "source_id long, dest_id long")
    users = spark.createDataFrame([(i, i < 30) for i in range(45)], "id long, is_core boolean")
    accounts = spark.createDataFrame([(i, 100 + i, 200 + i) for i in range(40)], "id long, last_message_id long, last_nrt_message_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_source, by_dest = bucketed(edges, "source_id"), bucketed(edges, "dest_id")
        core = network.from_core(by_source, users)
        plans = (
            (core, network.from_core(edges, users), 1, "source_id"),
            (core.groupBy("source_id").count(), network.from_core(edges, users).groupBy("source_id").count(), 1, "source_id"),
            (prep.edges_with_last_messages(by_source, accounts), prep.edges_with_last_messages(edges, accounts), 1, "source_id"),
            (network.to_known(by_dest, users), network.to_known(edges, users), 1, "dest_id"),
            (by_dest.groupBy("dest_id").count(), edges.groupBy("dest_id").count(), 0, "dest_id"),
        )
        for stored, plain, exchanges, column in plans:
            plan = stored._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange" in line]
            assert len(moved) == exchanges, plan
            assert "Bucketed: true" in plan
            key = lambda row: repr(sorted(row.asDict().items()))
            assert sorted(map(key, stored.collect())) == sorted(map(key, plain.collect())) and column in stored.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_appends_in_parts_keep_null_and_negative_ids(spark, tmp_path):
    rows = [(v, i) for i, v in enumerate([None, -5, -4, -1, 0, 1, 2, 9, None])]
    for parts in (1, 2, 3):
        path = str(tmp_path / str(parts))
        sinks.append_in_parts(spark.createDataFrame(rows, "user_id long, n int"), "user_id", parts, path)
        assert sorted(map(tuple, spark.read.parquet(path).collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("angle", [1.0, 1e-3, 1e-6, 0.0])
def test_nearly_collinear_regressors_are_fitted_like_a_dense_decomposition(spark, angle):
    draw = np.random.default_rng(3)
    n, zeros, base = 400, 150, 0.25
    x = draw.normal(size=n)
    y = 2 * x + angle * draw.normal(size=n)
    tt = 1.5 * x - 0.5 * y + 0.1 * draw.normal(size=n) * max(angle, 1e-3)
    rows = [(i, 1, float(t), float(a), float(b) - base, 0, 1) for i, (t, a, b) in enumerate(zip(tt, x, y))]
    support = spark.createDataFrame(rows, "id long, topic int, tt double, x double, y double, friend_flag int, base_flag int").repartition(5)
    topics = spark.createDataFrame([("t", 1, 1.0, base)], "feat string, topic int, divisor double, base_avg double")
    flags = spark.createDataFrame([(0, 1)] * (n + zeros), "friend_flag int, base_flag int")
    attach = lambda rows, table: rows.join(table, "topic")
    sums = influence.moments(attach(support, topics.select("topic", "base_avg")), topics, flags)
    fit = influence.least_squares(sums, influence.residual_sums(support, sums, 1, attach)).first()
    f, r, t = (np.concatenate((own, np.full(zeros, rest))) for own, rest in ((x, 0.0), (y, base), (tt, 0.0)))
    dense = np.linalg.lstsq(np.column_stack((f - f.mean(), r - r.mean())), t - t.mean(), rcond=1e-13)[0]
    assert np.allclose((fit.b_friends, fit.b_base), dense, rtol=1e-6, atol=1e-6)
    assert np.isclose(fit.c, t.mean() - dense @ (f.mean(), r.mean()), atol=1e-6)


def test_collinear_regressors_get_the_shortest_solution(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=100)
    rows = [(i, 1, float(3 * a + 0.1), float(a), float(2 * a), 0, 0) for i, a in enumerate(x)]
    support = spark.createDataFrame(rows, "id long, topic int, tt double, x double, y double, friend_flag int, base_flag int")
    topics = spark.createDataFrame([("t", 1, 1.0, 0.0)], "feat string, topic int, divisor double, base_avg double")
    flags = spark.createDataFrame([(0, 0)] * 100, "friend_flag int, base_flag int")
    attach = lambda rows, table: rows.join(table, "topic")
    sums = influence.moments(attach(support, topics.select("topic", "base_avg")), topics, flags)
    fit = influence.least_squares(sums, influence.residual_sums(support, sums, 0, attach)).first()
    assert np.allclose((fit.b_friends, fit.b_base), (0.6, 1.2), rtol=1e-9)


def test_appended_messages_are_numbered_in_their_ranges_only(spark, tmp_path):
    draw = random.Random(12)
    rows = [(i, draw.choice([3, *(draw.randrange(-40, 200) for _ in range(2))]), f"m{i}") for i in draw.sample(range(10_000), 600)]
    schema = "message_id long, user_id long, text string"
    late = [r for r in rows if r[1] in (3, 77, 199) and r[0] % 2] + [(20_000, 500, "beyond"), (20_001, -99, "before")]
    base = [r for r in rows if r not in late]
    stored = positioned.write_positions(spark.createDataFrame(base, schema), str(tmp_path / "p"), ranges=8)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in map(str, (tmp_path / "p").glob("range=*/*.parquet"))}
    before = files()
    stored, touched = positioned.append_positions(stored, spark.createDataFrame(late[:-1], schema))
    stored, more = positioned.append_positions(stored, spark.createDataFrame(late[-1:], schema))
    kept = {f for f, t in files().items() if before.get(f) == t}
    ranges = len({os.path.dirname(f) for f in before})
    assert more == [0] and 0 < len({*touched, 0}) < ranges and len(kept) == ranges - len({*touched, 0})
    expected = {key[1]: at for at, key in enumerate(sorted((user, message) for message, user, _ in base + late), 1)}
    assert {r["message_id"]: r["position"] for r in stored.read().collect()} == expected
    assert sorted(r["message_id"] for r in stored.of_user(77).collect()) == sorted(r[0] for r in base + late if r[1] == 77)
    plan = stored.of_user(77)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range" in plan or "range#" in plan.split("PartitionFilters:")[1][:80]
    assert sorted(r["position"] for r in stored.stretch(100, 130).collect()) == list(range(100, 131))
    assert positioned.append_positions(stored, spark.createDataFrame([], schema))[1] == []


def test_positions_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "message_id long, user_id long")
    stored = positioned.write_positions(none, str(tmp_path / "p"))
    stored, touched = positioned.append_positions(stored, spark.createDataFrame([(5, 1), (4, 1)], "message_id long, user_id long"))
    assert touched == [0] and sorted(tuple(r) for r in stored.read().select("message_id", "position").collect()) == [(4, 1), (5, 2)]


def test_stage_tables_are_removed_with_their_block(spark):
    outside = materialise(spark.range(3), "outside")
    with stage_tables(spark) as outer:
        materialise(spark.range(4), "a")
        with stage_tables(spark) as inner:
            kept = materialise(spark.range(5), "b").count()
        assert kept == 5 and len(inner) == 1 and len(outer) == 2 and os.path.exists(outer[0]) and not os.path.exists(inner[0])
    assert not any(map(os.path.exists, outer)) and outside.count() == 3
    with pytest.raises(ZeroDivisionError), stage_tables(spark) as failed:
        materialise(spark.range(1), "c")
        raise ZeroDivisionError
    assert not os.path.exists(failed[0])
