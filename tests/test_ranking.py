import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from langshift.operators.ranking import dense_index, group_rank, running_total
from langshift.operators.sampling import draw_people, permuted, round_keys
from langshift.operators.network import cap_friends, weighted
from langshift.operators.skew import attach_small, fan_out_join, heavy_pairs, hot_keys


def messages(spark, sizes, seed=0):
    """`sizes` messages per user, ids shuffled over users and with gaps."""
    rng = random.Random(seed)
    owners = [user for user, size in sizes.items() for _ in range(size)]
    rng.shuffle(owners)
    rows = [(3 * i + rng.randrange(3), owner) for i, owner in enumerate(owners)]
    return spark.createDataFrame(rows, "message_id long, user_id long"), rows


def expected_ranks(rows):
    ranks = {}
    for user, group in itertools.groupby(sorted(rows, key=lambda row: (row[1], row[0])), key=lambda row: row[1]):
        group = list(group)
        ranks |= {message: (i + 1, len(group)) for i, (message, _) in enumerate(group)}
    return ranks


@pytest.mark.parametrize("min_rows", [10**6, 40, 1])
def test_group_rank_with_and_without_hot_users(spark, min_rows):
    frame, rows = messages(spark, {1: 3000, 2: 5, 3: 700, 4: 1, 5: 45})
    assert (hot_keys(frame, "user_id", min_rows) is None) == (min_rows == 10**6)
    found = {row.message_id: (row.rn, row.n) for row in group_rank(frame, "user_id", "message_id", min_rows).collect()}
    assert found == expected_ranks(rows)


def test_hot_user_is_cut_into_balanced_parts(spark):
    from langshift.operators.ranking import _cut_points, _part_number

    frame, _ = messages(spark, {1: 4000, 2: 30})
    hot = hot_keys(frame, "user_id", 100)
    cuts = _cut_points(frame, "user_id", "message_id", hot)
    parted = frame.where("user_id = 1").join(cuts, "user_id").withColumn("part", _part_number("message_id"))
    sizes = [row["count"] for row in parted.groupBy("part").count().collect()]
    assert len(sizes) >= 30 and max(sizes) <= 200


def test_group_rank_from_start_positions(spark):
    frame, rows = messages(spark, {1: 300, 2: 20})
    starts = spark.createDataFrame([(1, 1000), (2, 5000)], "user_id long, start long")
    ranks = expected_ranks(rows)
    owner = dict(rows)
    for min_rows in (10**6, 10):
        for row in group_rank(frame, "user_id", "message_id", min_rows, starts).collect():
            assert row.rn == ranks[row.message_id][0] + {1: 1000, 2: 5000}[owner[row.message_id]]


def test_dense_index_and_running_total(spark):
    rows = [(i * 7919 % 1009, i % 13) for i in range(1009)]
    frame = spark.createDataFrame(rows, "id long, amount long").repartition(5)
    index = {row.id: row["index"] for row in dense_index(frame, [F.desc("id")]).collect()}
    assert index == {key: 1008 - key for key in range(1009)}
    totals = {row.id: row.before for row in running_total(frame, [F.asc("id")], "amount", "before").collect()}
    amounts = dict(rows)
    assert totals == dict(zip(range(1009), itertools.accumulate((amounts[i] for i in range(1009)), initial=0)))


def test_fan_out_join_with_hot_keys_on_both_sides(spark):
    left = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 1), (3, 1), (4, 7)], "k long, a long")
    right = spark.createDataFrame([(1, i) for i in range(20)] + [(2, i) for i in range(50)] + [(5, 1)], "k long, b long")
    plain = sorted(tuple(row) for row in left.join(right, "k").collect())
    split = fan_out_join(
        left,
        right,
        "k",
        left_hot=hot_keys(left, "k", 10),
        right_hot=hot_keys(right, "k", 10),
        left_spread=("a",),
        right_spread=("b",),
    )
    assert split.columns == ["k", "a", "b"]
    assert sorted(tuple(row) for row in split.collect()) == plain
    assert hot_keys(left, "k", 1000) is None


def test_attach_small_beyond_the_limit(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(100)], "id long, feat string")
    table = spark.createDataFrame([("t0", 1.0), ("t1", 2.0)], "feat string, v double")
    small = attach_small(rows, table, "feat", 2, ("id",))
    large = attach_small(rows, table, "feat", 2, ("id",), limit=1)
    key = lambda frame: sorted((row.id, row.feat, row.v) for row in frame.collect())
    assert key(small) == key(large) and len(key(small)) == 67


def test_draws_are_distinct_and_complete(spark):
    users = spark.createDataFrame([(i * 11,) for i in range(40)], "id long")
    drawers = spark.createDataFrame([(0, 7), (11, 40), (22, 500), (33, 0), (44, 1)], "id long, degree long")
    draws = {}
    for row in draw_people(drawers, users, seed=3).collect():
        draws.setdefault(row.source_id, []).append((row.dest_id, row.drawn))
    assert {user: len(people) for user, people in draws.items()} == {0: 7, 11: 40, 22: 40, 44: 1}
    for people in draws.values():
        ids = [person for person, _ in people]
        assert len(set(ids)) == len(ids) and {count for _, count in people} == {len(ids)}
        assert set(ids) <= {i * 11 for i in range(40)}
    again = {(row.source_id, row.dest_id) for row in draw_people(drawers, users.repartition(3), seed=3).collect()}
    assert again == {(user, person) for user, people in draws.items() for person, _ in people}
    other = {(row.source_id, row.dest_id) for row in draw_people(drawers, users, seed=4).collect()}
    assert other != again


def test_draws_are_about_uniform(spark):
    users = spark.createDataFrame([(i,) for i in range(20)], "id long")
    drawers = spark.createDataFrame([(i, 5) for i in range(2000)], "id long, degree long")
    counts = draw_people(drawers, users).groupBy("dest_id").count().collect()
    assert len(counts) == 20
    assert all(abs(row["count"] - 500) < 6 * math.sqrt(500) for row in counts)


def test_pairs_of_draws_are_about_uniform(spark):
    """Over many drawing users every pair of people, neighbours in the order too, is drawn together alike."""
    people, draws, drawers = 13, 4, 6000
    users = spark.createDataFrame([(i,) for i in range(people)], "id long")
    frame = spark.createDataFrame([(i, draws) for i in range(drawers)], "id long, degree long")
    sets = draw_people(frame, users).groupBy("source_id").agg(F.collect_set("dest_id").alias("people")).collect()
    assert len(sets) == drawers and all(len(row.people) == draws for row in sets)
    pairs = Counter(pair for row in sets for pair in itertools.combinations(sorted(row.people), 2))
    share = draws * (draws - 1) / (people * (people - 1))
    chi2 = sum((pairs[pair] - drawers * share) ** 2 / (drawers * share * (1 - share)) for pair in itertools.combinations(range(people), 2))
    assert len(pairs) == 78 and chi2 < 78 + 5 * math.sqrt(2 * 78)


def test_permutations_are_permutations_of_every_size(spark):
    rows = [(size, place) for size in [*range(1, 40), 101, 1000] for place in range(size)]
    frame = spark.createDataFrame(rows, "size long, place long").withColumn("keys", round_keys(F.col("size"), 1))
    got: dict[int, list] = {}
    for row in permuted(frame, "place", "size", "keys", "to").collect():
        got.setdefault(row["size"], []).append(row["to"])
    assert all(sorted(places) == list(range(size)) for size, places in got.items())
    wide = spark.range(1000).select((F.col("id") * 10**12 + 7).alias("place"), F.lit(10**15 + 3).alias("size"))
    far = permuted(wide.withColumn("keys", round_keys(F.lit(5), 1)), "place", "size", "keys", "to").select("to").collect()
    assert len({row["to"] for row in far}) == 1000 and all(0 <= row["to"] < 10**15 + 3 for row in far)
    assert abs(sum(row["to"] for row in far) / 1000 / 10**15 - 0.5) < 0.06


def test_a_draw_is_placed_by_generated_code(spark):
    """Lambdas, which are interpreted, only for the few places that the network leads outside."""
    rows = spark.range(9).select("id", F.lit(50).cast("long").alias("size")).withColumn("keys", round_keys(F.col("id"), 1))
    plan = permuted(rows, "id", "size", "keys", "to")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and not [line for line in plan.splitlines() if "aggregate(" in line and "CASE WHEN" not in line.split("aggregate(")[0]]


def test_drawing_takes_no_more_shuffles_than_the_join(spark):
    users = spark.createDataFrame([(i,) for i in range(50)], "id long")
    plan = draw_people(users.withColumn("degree", F.lit(3)), users)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_id") == 1 and "CartesianProduct" not in plan


def test_cap_of_an_edge_with_a_huge_weight(spark):
    edges = [(1, 1, 10**9), (1, 2, 10**9), (2, 3, 10**9), (2, 4, 1)]
    capped = {tuple(row) for row in cap_friends(spark.createDataFrame(edges, "source_id long, dest_id long, weight long"), 10).collect()}
    assert sum(row[2] for row in capped if row[0] == 1) == 10 and (2, 3, 10) in capped
    many = [(source, dest, 10**9 * dest) for source in range(3000) for dest in (1, 2)]
    drawn = cap_friends(spark.createDataFrame(many, "source_id long, dest_id long, weight long"), 3).collect()
    of_two, total = sum(row.weight for row in drawn if row.dest_id == 2), sum(row.weight for row in drawn)
    assert total == 9000 and abs(of_two / total - 2 / 3) < 0.02  # draws from so many copies are as good as with replacement


def test_cap_leaves_out_each_copy_alike(spark):
    """With 5, 3 and 1 copies and a cap of 4, the copies drawn follow the multivariate hypergeometric law."""
    edges = [(source, dest, weight) for source in range(5000) for dest, weight in ((1, 5), (2, 3), (3, 1))]
    capped = cap_friends(spark.createDataFrame(edges, "source_id long, dest_id long, weight long"), 4).collect()
    drawn: dict = {}
    for row in capped:
        drawn.setdefault(row.source_id, {})[row.dest_id] = row.weight
    seen = Counter(tuple(d.get(dest, 0) for dest in (1, 2, 3)) for d in drawn.values())
    for (a, b, c), n in seen.items():
        share = math.comb(5, a) * math.comb(3, b) * math.comb(1, c) / math.comb(9, 4)
        assert abs(n - 5000 * share) < 5 * math.sqrt(5000 * share)
    assert sum(seen.values()) == 5000


def test_cap_is_a_repeatable_subset(spark):
    edges = [(1, i) for i in range(50)] + [(2, i) for i in range(5)] + [(3, 9)] * 30
    frame = weighted(spark.createDataFrame(edges, "source_id long, dest_id long"))
    capped = sorted(tuple(row) for row in cap_friends(frame, 10).collect())
    assert capped == sorted(tuple(row) for row in cap_friends(frame.repartition(3), 10).collect())
    assert [sum(edge[2] for edge in capped if edge[0] == source) for source in (1, 2, 3)] == [10, 5, 10]
    assert {edge[:2] for edge in capped} <= set(edges)
    limited = cap_friends(frame, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in limited


def test_cap_draws_copies_alike(spark):
    """Of the edges A, A, B each copy is drawn in a third of all cases."""
    edges = [(i, dest, weight) for i in range(4000) for dest, weight in ((1, 2), (2, 1))]
    drawn = cap_friends(spark.createDataFrame(edges, "source_id long, dest_id long, weight long"), 1).collect()
    assert len(drawn) == 4000
    assert abs(sum(row.dest_id == 2 for row in drawn) / 4000 - 1 / 3) < 0.03


def test_a_key_that_makes_many_rows_is_split_though_short_on_both_sides(spark):
    left = spark.createDataFrame([(1, i) for i in range(900)] + [(k, 0) for k in range(2, 400)], "k long, a long")
    right = spark.createDataFrame([(1, i) for i in range(900)] + [(k, 0) for k in range(2, 400)], "k long, b long")
    left_hot, right_hot = heavy_pairs(left, right, "k", 1000)
    split = fan_out_join(left, right, "k", left_hot, right_hot, ("a",), ("b",))
    rows = split.groupBy(F.spark_partition_id().alias("task")).count().collect()
    total = sum(row["count"] for row in rows)
    assert total == 900 * 900 + 398
    assert max(row["count"] for row in rows) <= 2 * total / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert split.distinct().count() == total
    assert heavy_pairs(left, right, "k", 10**6) == (None, None)
