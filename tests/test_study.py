import numpy as np
import pytest
from pyspark.sql import functions as F

from langshift.config import PRESETS
from langshift.operators import features as feature_ops
from langshift.plans.study import Study
from study_data import HAND, SCORES, Dense, Inputs, assert_close, by_topic, random_inputs

COSINES = ("cos_friends", "cos_base")
FIT = ("b_friends", "b_base", "intercept", "mae")


def make(spark, inputs, variant="minmax_population", min_degree=5, **options):
    changes = {name: options.pop(name) for name in ("normalise", "baseline", "vocab_scope") if name in options}
    settings = PRESETS[variant].but(min_degree=min_degree, **changes)
    return Study(*inputs.frames(spark), settings, **options)


@pytest.fixture(scope="module")
def hand(spark):
    return make(spark, HAND, min_degree=2)


def test_hand_topics_and_statistics(hand):
    assert {row.feat for row in hand.topics.collect()} == {"a", "b"}
    stats = by_topic(hand.statistics, "mean2", "var2", "min2", "max2")
    assert_close({k: stats[k] for k in "ab"}, {"a": (0.533333, 0.058889, 0.2, 0.9), "b": (0.366667, 0.095556, 0, 0.8)}, 1e-6)


def test_hand_friend_averages(hand):
    found = {(row.id, row.feat): row.friend_avg for row in hand.friend_averages.collect()}
    expected = {(1, "a"): 0.55, (2, "a"): 0.7, (3, "a"): 0.3, (1, "b"): 0.45, (2, "b"): 0.05, (3, "b"): 0.7}
    assert found == pytest.approx(expected)


def test_hand_cosines(hand):
    assert_close(by_topic(hand.cosines, *COSINES), {"a": (0.907464, 0.907464), "b": (0.843457, 0.744221)}, 1e-6)
    difference = by_topic(hand.cosines, "cos_diff")
    assert difference["a"] == (0.0,)
    assert difference["b"] == pytest.approx((0.099237,), abs=1e-6)


def test_hand_least_squares(spark):
    raw = by_topic(make(spark, HAND, "ols_population", 2, normalise=None).fits, *FIT)
    assert_close(raw, {"a": (0.489796, 0.326531, -0.081293, 0.136054), "b": (2.6, -3.9, -0.14, 0)}, 1e-6)
    scaled = by_topic(make(spark, HAND, "ols_population", 2).fits, "intercept")
    assert_close(scaled, {"a": (-0.116132,), "b": (-0.175,)}, 1e-6)


@pytest.mark.parametrize("seed", [1])
def test_population_study_equals_dense(spark, seed):
    inputs = random_inputs(seed)
    dense = Dense(inputs, 5)
    assert 3 < len(dense.kept) < len(dense.core)
    study = make(spark, inputs)
    assert {row.id for row in study.kept.collect()} == set(dense.kept)
    assert_close(by_topic(study.cosines, *COSINES), dense.cosines(method="minmax"))
    fitted = by_topic(make(spark, inputs, "ols_population").fits, *FIT)
    assert_close(fitted, dense.fits(method="minmax"), 1e-7)


def test_deltas_equal_dense(spark):
    inputs = random_inputs(3)
    dense = Dense(inputs, 5)
    parts = dense.deltas(method="minmax")
    found = {(row.id, row.feat): (row.tt, row.tf, row.tr) for row in make(spark, inputs).deltas.collect()}
    for i, user in enumerate(dense.kept):
        for j in dense.varying:
            expected = [part[i, j] for part in parts]
            if (user, dense.names[j]) in found:
                np.testing.assert_allclose(found[user, dense.names[j]], expected, atol=1e-12)
            else:
                assert expected[:2] == [0, 0]


def test_random_baseline_equals_dense(spark):
    inputs = random_inputs(4)
    study = make(spark, inputs, "capped_random")
    drawn: dict = {}
    for row in study.draws.collect():
        drawn.setdefault(row.source_id, []).append(row.dest_id)
    dense = Dense(inputs, 5)
    assert_close(by_topic(study.cosines, *COSINES), dense.cosines(drawn=drawn))


def test_normalisation_cancels_in_cosines(spark):
    inputs = random_inputs(5)
    raw, minmax, variance = (
        by_topic(make(spark, inputs, normalise=method).cosines, *COSINES) for method in (None, "minmax", "variance")
    )
    assert_close(minmax, raw)
    assert_close(variance, raw)


def test_normalised_scores(spark):
    inputs = random_inputs(6)
    dense = Dense(inputs, 5)
    last = dense.values[2]
    for method, shift in (("minmax", last.min(axis=0)), ("variance", last.mean(axis=0))):
        scale = dense.scale(method)
        for row in make(spark, inputs, normalise=method).normalised.collect():
            j = dense.names.index(row.feat)
            value = dense.values[row.slice, dense.place[row.group_id], j]
            assert row.score == pytest.approx((value - shift[j]) / scale[j])
            assert row.zero_score == pytest.approx(-shift[j] / scale[j])


def test_copies_of_edges_count(spark):
    inputs = random_inputs(7)
    single = Inputs(inputs.users, sorted(set(inputs.network)), inputs.features)
    many = by_topic(make(spark, inputs, min_degree=2).cosines, *COSINES)
    once = by_topic(make(spark, single, min_degree=2).cosines, *COSINES)
    assert many != once


def test_an_inactive_user_changes_the_population_mean(spark):
    inputs = random_inputs(8)
    more = Inputs([*inputs.users, (999, False)], inputs.network, inputs.features)
    before, after = (by_topic(make(spark, part).statistics, "n", "mean2") for part in (inputs, more))
    for feat, (people, mean) in before.items():
        assert after[feat] == (people + 1, pytest.approx(mean * people / (people + 1)))


def test_hot_keys_and_large_vocabulary_change_nothing(spark):
    inputs = random_inputs(9)
    plain = make(spark, inputs)
    split = make(spark, inputs, min_hot_rows=3, broadcast_rows=0, map_side_bytes=0)
    assert split._hot_friends != (None, None)
    assert_close(by_topic(split.cosines, *COSINES), by_topic(plain.cosines, *COSINES), 1e-12)
    fits = [make(spark, inputs, "ols_population", **options).fits for options in ({}, {"min_hot_rows": 3, "broadcast_rows": 0, "map_side_bytes": 0})]
    assert_close(by_topic(fits[1], *FIT), by_topic(fits[0], *FIT), 1e-9)


@pytest.mark.parametrize("variant", ["minmax_population", "capped_random"])
def test_scores_copied_to_tasks_and_shuffled_ones_add_up(spark, variant):
    """With room for none, some and all of the most-followed people the scores are the same."""
    inputs = random_inputs(11)
    whole = make(spark, inputs, variant)
    assert whole._packed[1] is None
    expected = by_topic(whole.cosines, *COSINES)
    none = make(spark, inputs, variant, map_side_bytes=0)
    assert none._packed[0] is None
    some = make(spark, inputs, variant, map_side_bytes=3000)
    heavy, light = some._packed
    chosen = {row.dest_id for row in heavy.collect()}
    links = {row.dest_id: row["count"] for row in some.edges.groupBy("dest_id").count().collect()}
    others = {row.dest_id for row in light.collect()}
    assert chosen and others and not chosen & others
    assert min(links[person] for person in chosen) >= max(links.get(person, 0) for person in others)
    for study in (none, some):
        assert_close(by_topic(study.cosines, *COSINES), expected, 1e-12)


def test_copied_scores_leave_links_where_they_lie(spark):
    """No exchange of the joined arrays: only sums by user and topic move."""
    study = make(spark, random_inputs(11))
    plan = study.friend_averages._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(source_id" not in plan.split("Generate explode(scores")[0]


def test_partition_count_does_not_matter(spark):
    inputs = random_inputs(10)
    expected = by_topic(make(spark, inputs, "capped_random").cosines, *COSINES)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert_close(by_topic(make(spark, inputs, "capped_random").cosines, *COSINES), expected, 1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nobody_kept_gives_no_topics(spark):
    assert make(spark, HAND, min_degree=50).cosines.count() == 0
    assert make(spark, HAND, "ols_population", min_degree=50).fits.count() == 0


def test_empty_selection(spark):
    empty = Inputs([(99, False)], HAND.network, HAND.features)
    assert make(spark, empty).cosines.count() == 0


def test_vocabulary_and_unknown_topics(spark):
    features = HAND.frames(spark)[2]
    assert {row.feat for row in feature_ops.vocabulary(features).collect()} == {"a", "b", "c", "z"}
    first = feature_ops.vocabulary(features, "first")
    assert {row.feat for row in first.collect()} == {"a", "b", "c"}
    assert feature_ops.unknown_topics(features, first).first() == (1, 2)
    dictionary = {row.feat: row.topic_id for row in feature_ops.topic_dictionary(features).collect()}
    assert dictionary == {"a": 1, "b": 2, "c": 3, "z": 4}


def test_counts(spark):
    inputs = random_inputs(11)
    dense = Dense(inputs, 5)
    counts = {row.stage: row.n for row in make(spark, inputs).counts.collect()}
    assert counts["all_users"] == len(inputs.users)
    assert counts["core_users"] == len(dense.core)
    assert counts["kept_users"] == len(dense.kept)
    assert counts["masked_users"] == len(dense.core) - len(dense.kept)
    assert counts["kept_topics"] == len(dense.varying)


# ---- trust ----------------------------------------------------------------------------------------


def trust_study(spark, seed):
    inputs = random_inputs(seed)
    rng = np.random.default_rng(seed)
    scores = [
        (user, 5 if is_core else 1, float(rng.random()), float(rng.random()), float(rng.normal())) for user, is_core in inputs.users
    ]
    scores[1] = (*scores[1][:4], float("nan"))
    scores[2] = (*scores[2][:4], None)
    scores[3] = (*scores[3][:4], float("inf"))
    scores[6] = (*scores[6][:2], float("nan"), 0.5, 0.1)
    scores[7] = (*scores[7][:2], None, None, 0.1)
    _, network, features = inputs.frames(spark)
    study = Study.of_trust(spark.createDataFrame(scores, SCORES), network, features, PRESETS["trust"].but(min_degree=5))
    return inputs, scores, study


def test_trust_study_equals_dense(spark):
    inputs, _, study = trust_study(spark, 12)
    dense = Dense(inputs, 5, restrict=False)
    drawn: dict = {}
    for row in study.draws.collect():
        drawn.setdefault(row.source_id, []).append(row.dest_id)
    unaveraged = set(dense.core) - {row.user_id for row in study.averaged.collect()}
    assert len(unaveraged & set(dense.kept)) >= 2
    assert_close(by_topic(study.cosines, *COSINES), dense.cosines(method="variance", drawn=drawn, unaveraged=unaveraged))


def test_trust_averages_skip_missing_scores(spark):
    inputs, scores, study = trust_study(spark, 13)
    dense = Dense(inputs, 5)
    value = {row[0]: np.nan if row[2] is None else row[2] for row in scores}
    for row in study.averaged.collect():
        assert row.avg_friends == pytest.approx(np.nanmean([value[friend] for friend in dense.friends[row.user_id]]))


def test_trust_differences(spark):
    from langshift.operators.trust import trust_differences

    _, scores, study = trust_study(spark, 14)
    found = {row.user_id: row for row in trust_differences(study.scores, study.averaged, study.draws).collect()}
    assert len(found) == len(scores)
    assert found[1].avg_friends is None and found[1].diff_friends is None
    assert found[0].diff_friends == pytest.approx(found[0].avg_friends - found[0].first_part)
    assert found[7].first_part is None and found[7].diff_friends is None


def test_trust_has_no_least_squares(spark):
    _, _, study = trust_study(spark, 15)
    with pytest.raises(ValueError):
        study.fits


def test_account_selection(spark):
    from langshift.operators import users as user_ops

    accounts = spark.createDataFrame(
        [(1, 1, 300, 30), (1, 1, 300, 30), (2, 3, 300, 30), (3, 2, 300, 5), (4, 2, 100, 30), (5, None, 300, 30), (6, 2, 200, None)],
        "id long, level int, statuses_count long, recorded_friends_count long",
    )
    everybody = {row.id for row in user_ops.select_users(accounts, 3, 200, 0).collect()}
    core = {row.id for row in user_ops.select_users(accounts, 2, 200, 25).collect()}
    assert everybody == {1, 2, 3} and core == {1}  # an unknown friends count fails the test
    users = user_ops.study_users(accounts, PRESETS["minmax_population"])
    assert {(row.id, row.is_core) for row in users.collect()} == {(1, True), (2, False), (3, False)}
    uncounted = user_ops.study_users(accounts, PRESETS["capped_random"].but(all_level=2))
    assert 6 in {row.id for row in uncounted.collect()}
    assert {row.id for row in user_ops.periphery_of(users).collect()} == {2, 3}
    index = {row.id: row.user_index for row in user_ops.user_index(users).collect()}
    assert index == {1: 0, 2: 1, 3: 2}


@pytest.mark.parametrize("spread", [1e-5, 1e-7, 1e-9])
def test_topics_that_hardly_vary_keep_their_precision(spark, spread):
    """One topic around 0.7 that everybody has in every slice: sums of squares would cancel."""
    inputs = random_inputs(6)
    rng = np.random.default_rng(8)
    users = [(user, True) for user, _ in inputs.users]
    near = [(s, 10**6 + 3 * user + s, user, "near", 1.0, 0.7 + spread * float(rng.random())) for s in range(3) for user, _ in users]
    inputs = Inputs(users, inputs.network, [*inputs.features, *near])
    dense = Dense(inputs, 5)
    assert "near" in {dense.names[j] for j in dense.varying}
    found = by_topic(make(spark, inputs).cosines, *COSINES)
    assert_close({"near": found["near"]}, {"near": dense.cosines(method="minmax")["near"]}, 1e-5)
    fitted = by_topic(make(spark, inputs, "ols_population").fits, *FIT)["near"]
    np.testing.assert_allclose(fitted, dense.fits(method="minmax")["near"], rtol=1e-3, atol=1e-3)
    scaled = make(spark, inputs, normalise="variance")
    assert all(np.isfinite(row.score) for row in scaled.normalised.where("feat = 'near'").collect())
    assert scaled.deltas.where("feat = 'near'").count() >= len(dense.kept)


def test_many_users_are_not_broadcast(spark):
    """Beyond the bound on rows no table of one row per user is, however small its files are."""
    study = make(spark, random_inputs(3), "capped_random", broadcast_rows=0)
    for frame in (study.own_cells, study.friend_links):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=shuffle_hash" in plan
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().sparkPlan().toString()
