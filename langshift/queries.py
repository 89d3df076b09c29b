"""The query registry: one named DataFrame per operator, over a folder of order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langshift.fixtures import VARIANTS, Fixture, StoredFixture
from langshift.functions.columns import rounded
from langshift.operators import features as feature_ops
from langshift.operators import idsets, insert, last_messages, positioned, prep
from langshift.operators import influence as influence_ops
from langshift.operators import network as network_ops
from langshift.operators import trust as trust_ops
from langshift.operators import users as user_ops
from langshift.operators.storage import materialise, stage_path
from langshift.plans.order_free import OrderFree
from langshift.plans.study import Study
from langshift.sources import sinks
from langshift.sources.bucketed import bucketed
from langshift.sources.tables import TRUST_COLUMNS, require_columns

FIRST_USER = 7
BATCHES = 4
LATE = 7  # of the last two digits of a message's id
ENRICHED = ("id", "last_message_id", "last_message_date", "last_nrt_message_id", "last_nrt_message_date")
THRESHOLD = 0.002


_inputs: dict[tuple[str, str], StoredFixture] = {}


def study_inputs(fixture: Fixture) -> StoredFixture:
    """The input tables of the studies over a folder, written once per Spark application."""
    key = (fixture.spark.sparkContext.applicationId, fixture.folder)
    if key not in _inputs:
        _inputs[key] = StoredFixture(fixture.spark, fixture.folder)
    return _inputs[key]


def study(fixture: Fixture, variant: str = "minmax_population", tercile: int = 0) -> Study:
    """A study over the stored inputs; they are written when a query first needs them."""
    settings, stored = VARIANTS[variant], study_inputs(fixture)
    inputs = (lambda: stored.network, lambda: stored.features(tercile), settings)
    if variant == "trust":
        return Study.of_trust(stored.trust_scores, *inputs)
    return Study.of_accounts(lambda: stored.accounts, *inputs)


def _round(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: rounded(F.col(name)) for name in names})


def _round_money(frame: DataFrame, *names: str) -> DataFrame:
    """Three digits; half units, frequent in means of prices, round up in spite of summation noise."""
    return frame.withColumns({name: rounded(F.col(name) + F.lit(1e-7), 3) for name in names})


def _long(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.col(name).cast("long") for name in names})


_COSINES = ("cos_friends", "cos_base", "cos_diff")
_FIT = ("b_friends", "b_base", "intercept", "mae")


# ---- users and edges ------------------------------------------------------------------------------


def users_all(fx: Fixture) -> DataFrame:
    v = VARIANTS["minmax_population"]
    return user_ops.select_users(fx.accounts, v.all_level, v.min_statuses, v.min_recorded)


def users_core(fx: Fixture) -> DataFrame:
    v = VARIANTS["minmax_population"]
    return user_ops.select_users(fx.accounts, v.core_level, v.min_statuses, v.min_friends)


def users_kept(fx: Fixture) -> DataFrame:
    return study(fx).kept


def users_loaded(fx: Fixture) -> DataFrame:
    return study(fx).loaded


def users_loaded_set(fx: Fixture) -> DataFrame:
    """The loaded users as the members of the union of two bitmap sets."""
    s = study(fx)
    return idsets.members(idsets.union(idsets.id_set(user_ops.core_of(s.users), "id"), idsets.id_set(s.edges, "dest_id")))


def user_set_sizes(fx: Fixture) -> DataFrame:
    """Sizes of the user sets and of what they share, from bitmaps alone."""
    s = study(fx)
    everybody = materialise(idsets.id_set(s.users, "id"), "set-all")
    core = materialise(idsets.id_set(user_ops.core_of(s.users), "id"), "set-core")
    followed = materialise(idsets.id_set(s.edges, "dest_id"), "set-followed")
    return fx.spark.range(1).select(
        idsets.size(everybody).alias("all_users"),
        idsets.size(core).alias("core_users"),
        idsets.size(idsets.union(core, followed)).alias("loaded_users"),
        (idsets.size(everybody) - idsets.overlap(everybody, core)).alias("periphery"),
        idsets.overlap(core, followed).alias("core_followed"),
    )


def users_periphery(fx: Fixture) -> DataFrame:
    return user_ops.periphery_of(study(fx).users)


def user_degree(fx: Fixture) -> DataFrame:
    return study(fx).degrees


def user_index(fx: Fixture) -> DataFrame:
    return user_ops.user_index(study(fx).users)


def edges_core(fx: Fixture) -> DataFrame:
    s = study(fx)
    return network_ops.between(s.network, s.users)


def edges_capped(fx: Fixture) -> DataFrame:
    return study(fx, "capped_random").edges


def random_people(fx: Fixture) -> DataFrame:
    return study(fx, "capped_random").draws


# ---- features -------------------------------------------------------------------------------------


def features_loaded(fx: Fixture) -> DataFrame:
    s = study(fx)
    rows = feature_ops.restrict_features(s.features, s.users, s.loaded)
    return _long(_round(rows.select("slice", "group_id", "feat", "group_norm"), "group_norm"), "slice")


def features_by_tercile(fx: Fixture) -> DataFrame:
    """Rows, users and scores of each slice under the three choices of the reference period."""
    stacked = None
    for tercile in (0, 1, 2):
        sizes = fx.features(tercile).groupBy("slice", "feat").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value"), F.sum("group_norm").alias("group_norm")
        )
        sizes = sizes.withColumn("tercile", F.lit(tercile))
        stacked = sizes if stacked is None else stacked.unionByName(sizes)
    return _long(_round(stacked, "group_norm"), "slice", "tercile", "value")


def features_var_norm(fx: Fixture) -> DataFrame:
    s = study(fx, "capped_random")
    return _long(_round(s.normalised, "score", "zero_score"), "slice")


def features_minmax_norm(fx: Fixture) -> DataFrame:
    return _long(_round(study(fx).normalised, "score", "zero_score"), "slice")


def vocab(fx: Fixture) -> DataFrame:
    return feature_ops.vocabulary(fx.features())


def topic_dictionary(fx: Fixture) -> DataFrame:
    return _long(feature_ops.topic_dictionary(fx.features()), "first_slice")


def unknown_topics(fx: Fixture) -> DataFrame:
    features = fx.features(1)
    return feature_ops.unknown_topics(features, feature_ops.vocabulary(features, "first"))


def _long_statistics(s: Study, statistics: DataFrame) -> DataFrame:
    known = s.vocabulary.join(statistics, "feat", "left").fillna(0)  # words without a row in scope are zero throughout
    return feature_ops.slice_statistics(known)


def slice_topic_stats(fx: Fixture) -> DataFrame:
    s = study(fx)
    stats = _long_statistics(s, s.statistics)
    return _long(_round(stats, "mean", "var", "min", "max"), "slice")


def slice_topic_stats_order_free(fx: Fixture) -> DataFrame:
    """The statistics of `slice_topic_stats` without rounding: no bit depends on the order of the rows."""
    s = study(fx)
    return _long(_long_statistics(s, OrderFree(s).statistics), "slice")


def topics_kept(fx: Fixture) -> DataFrame:
    return study(fx).topics.select("feat")


# ---- averages, deltas, scores ---------------------------------------------------------------------


def friend_topic_avg(fx: Fixture) -> DataFrame:
    return _round(study(fx).friend_averages, "friend_avg")


def random_topic_avg(fx: Fixture) -> DataFrame:
    return _round(study(fx, "capped_random").base_averages, "base_avg")


def population_topic_avg(fx: Fixture) -> DataFrame:
    return _round(study(fx).topics.select("feat", "base_avg"), "base_avg")


def topic_deltas(fx: Fixture) -> DataFrame:
    return _round(study(fx).deltas, "tt", "tf", "tr")


def topic_cosine(fx: Fixture) -> DataFrame:
    return _round(study(fx).cosines.select("feat", "cos_friends", "cos_base"), "cos_friends", "cos_base")


def _influence(variant: str = "minmax_population", tercile: int = 0) -> Callable[[Fixture], DataFrame]:
    return lambda fx: _round(study(fx, variant, tercile).cosines, *_COSINES)


def topic_influence_order_free(fx: Fixture) -> DataFrame:
    """The cosines of `topic_influence` without rounding: no bit depends on the order of the rows."""
    return OrderFree(study(fx)).cosines


def topic_ols(fx: Fixture) -> DataFrame:
    return _round(study(fx, "ols_population").fits, *_FIT)


def friend_coefficient(fx: Fixture) -> DataFrame:
    fits = study(fx, "ols_population").fits.select("feat", "b_friends")
    return _round(sinks.above_threshold(fits, "b_friends"), "b_friends")


def influence_summary(fx: Fixture) -> DataFrame:
    return _round(influence_ops.summary(study(fx).cosines), "mean_cos_friends", "mean_cos_base")


def influence_above_threshold(fx: Fixture) -> DataFrame:
    strong = sinks.above_threshold(study(fx).cosines, "cos_diff", THRESHOLD)
    return sinks.score_lines(_round(strong, "cos_diff"), "feat", "cos_diff")


def ols_export_lines(fx: Fixture) -> DataFrame:
    return sinks.vector_lines(topic_ols(fx), "feat", list(_FIT))


def pipeline_counts(fx: Fixture) -> DataFrame:
    return study(fx).counts


# ---- trust ----------------------------------------------------------------------------------------


def trust_scan(fx: Fixture) -> DataFrame:
    scores = require_columns(fx.trust_scores, TRUST_COLUMNS).select(*TRUST_COLUMNS)
    return _round(scores, "wo_retweets", "first_part", "diff_score")


def trust_core(fx: Fixture) -> DataFrame:
    return user_ops.core_of(user_ops.trust_users(fx.trust_scores))


def trust_friend_avg(fx: Fixture) -> DataFrame:
    return _round_money(study(fx, "trust").averaged, "avg_friends")


def trust_diffs(fx: Fixture) -> DataFrame:
    s = study(fx, "trust")
    differences = trust_ops.trust_differences(s.scores, s.averaged, s.draws)
    names = ("avg_friends", "avg_random_people", "diff_friends", "diff_random_people")
    return _round_money(differences.select("user_id", *names), *names)


# ---- preparation ----------------------------------------------------------------------------------


def _members(fx: Fixture) -> DataFrame:
    return prep.core_members(fx.network, fx.accounts)


def _core_messages(fx: Fixture) -> DataFrame:
    return prep.messages_of(fx.messages_nrt, _members(fx), "dest_id")


def _core_accounts(fx: Fixture) -> DataFrame:
    return prep.core_accounts(fx.accounts, _members(fx))


def _stored_core(fx: Fixture) -> DataFrame:
    """Core accounts, written once for several readers; their ids are those of the core members."""
    return materialise(_core_accounts(fx), "core-accounts")


def _enriched_accounts(fx: Fixture, accounts: DataFrame) -> DataFrame:
    own = prep.messages_of(fx.messages_nrt, accounts, "id")
    return prep.with_last_messages(accounts, own, fx.messages)


def ring_reach_count(fx: Fixture) -> DataFrame:
    return prep.ring_reach_count(fx.network, fx.accounts, *prep.RING_COUNTERS)


def core_members(fx: Fixture) -> DataFrame:
    return _members(fx)


def core_messages(fx: Fixture) -> DataFrame:
    return _core_messages(fx)


def message_positions(fx: Fixture) -> DataFrame:
    return prep.message_positions(fx.messages_nrt).select("message_id", "user_id", "created_at", "position")


def positions_after_append(fx: Fixture) -> DataFrame:
    """Message positions of a table that one message in a hundred came to later."""
    messages, late = fx.messages_nrt, F.pmod(F.col("message_id"), F.lit(100)) == LATE
    stored = positioned.write_positions(messages.where(~late), stage_path(fx.spark, "positioned"))
    stored, _ = positioned.append_positions(stored, messages.where(late))
    return stored.read().select("message_id", "user_id", "created_at", "position")


def position_bounds(fx: Fixture) -> DataFrame:
    return prep.position_bounds(fx.messages_nrt)


def first_positions(fx: Fixture) -> DataFrame:
    return prep.first_positions(fx.messages_nrt).select("message_id", "user_id", "created_at", "position")


def user_first_messages(fx: Fixture) -> DataFrame:
    first = prep.user_first_messages(fx.messages_nrt, FIRST_USER)
    return first.select("message_id", "user_id", "created_at", "position")


def first_tercile_messages(fx: Fixture) -> DataFrame:
    return prep.first_part(fx.messages_nrt).select("message_id", "user_id", "created_at")


def first_tercile_by_bounds(fx: Fixture) -> DataFrame:
    positions = prep.message_positions(fx.messages_nrt)
    first = prep.first_tercile_by_bounds(positions, prep.position_bounds(fx.messages_nrt))
    return first.select("message_id", "user_id", "created_at", "position")


def tercile_sizes(fx: Fixture) -> DataFrame:
    return prep.part_sizes(prep.first_part(fx.messages_nrt))


def message_parts(fx: Fixture) -> DataFrame:
    """Half and third of every message."""
    parts = prep.message_parts(fx.messages_nrt, half=2, third=3)
    return _long(parts.select("message_id", "user_id", "half", "third"), "half", "third")


def accounts_core(fx: Fixture) -> DataFrame:
    return _core_accounts(fx).select("id", "username", "friends_count", "statuses_count")


def accounts_last_message(fx: Fixture) -> DataFrame:
    return _enriched_accounts(fx, _stored_core(fx)).select(*ENRICHED)


def accounts_last_merged(fx: Fixture) -> DataFrame:
    """The same from tables that batches of messages were merged into: late ones, one twice, with a compaction between."""
    accounts, stored = _stored_core(fx), []
    own = prep.messages_of(fx.messages_nrt, accounts, "id")
    for name, messages in (("nrt", own), ("all", fx.messages)):
        path, target = stage_path(fx.spark, f"last-{name}"), stage_path(fx.spark, f"last-{name}-compact")
        batch = F.pmod(F.col("message_id"), F.lit(BATCHES))
        last_messages.add_messages(messages.where(batch > 1), path)
        last_messages.compact(fx.spark, path, target)
        for number in (0, 1, 0):
            last_messages.add_messages(messages.where(batch == number), target)
        stored.append(last_messages.read_last(fx.spark, target))
    return last_messages.with_stored_last(accounts, *stored).select(*ENRICHED)


def accounts_inserted(fx: Fixture) -> DataFrame:
    """Core accounts, inserted in batches of the crawl's order into one table that keeps the first row of an id."""
    path, accounts = stage_path(fx.spark, "inserted"), fx.accounts
    cuts = accounts.agg(F.percentile_approx("counter", [0.4, 0.8], 1000)).first()[0] or [0, 0]
    rows = materialise(accounts.join(_members(fx).select(F.col("dest_id").alias("id")), "id", "left_semi"), "core-rows")
    counter = F.col("counter")
    for number, batch in enumerate((counter <= cuts[0], (counter > cuts[0]) & (counter <= cuts[1]), counter > cuts[1])):
        insert.insert_ignore(fx.spark, rows.where(batch), path, "id", "counter", exists=number > 0)
    return fx.spark.read.parquet(path).select("id", "username", "friends_count", "statuses_count")


def network_core(fx: Fixture) -> DataFrame:
    return prep.core_network(fx.network, _core_accounts(fx)).select("source_id", "dest_id")


def edges_last_message(fx: Fixture) -> DataFrame:
    accounts = _stored_core(fx)
    edges = prep.core_network(fx.network, accounts)
    return prep.edges_with_last_messages(edges, _enriched_accounts(fx, accounts))


def edges_last_bucketed(fx: Fixture) -> DataFrame:
    """The same over edges stored in buckets of their source, which neither the core filter nor the enrichment moves."""
    accounts = _stored_core(fx)
    edges = prep.core_network(bucketed(fx.network, "source_id"), accounts)
    return prep.edges_with_last_messages(edges, _enriched_accounts(fx, accounts))


def followers_bucketed(fx: Fixture) -> DataFrame:
    """Followers of every account in the study, counted over edges stored in buckets of their destination."""
    edges = network_ops.to_known(bucketed(fx.network, "dest_id"), study(fx).users)
    return edges.groupBy("dest_id").agg(F.count(F.lit(1)).alias("followers"))


def friend_messages(fx: Fixture) -> DataFrame:
    edges = materialise(prep.core_network(fx.network, _core_accounts(fx)), "core-edges")
    return prep.friend_messages(edges, fx.messages_nrt)


def friend_message_key_dups(fx: Fixture) -> DataFrame:
    return prep.duplicate_keys(friend_messages(fx), ("parent_id", "message_id"))


# ---- sinks ----------------------------------------------------------------------------------------


def vocab_lines(fx: Fixture) -> DataFrame:
    """The vocabulary as a list file, written and read again."""
    path = stage_path(fx.spark, "vocab-lines")
    sinks.write_lines(sinks.list_lines(vocab(fx), "feat"), path)
    return fx.spark.read.text(path).select(F.col("value").alias("line"))


def positions_appended(fx: Fixture) -> DataFrame:
    """Message positions appended to one table in two halves and read again."""
    path, positions = stage_path(fx.spark, "positions"), materialise(message_positions(fx), "positions-whole")
    sinks.append_in_parts(positions, "user_id", 2, path)
    return fx.spark.read.parquet(path)


def accounts_reshaped(fx: Fixture) -> DataFrame:
    """Account rows in a table made like the accounts, with a column added and one dropped."""
    accounts = fx.accounts.select("id", "username", "level", "counter")
    shaped = sinks.table_like(accounts, {"is_copy": "boolean"}, ("username",))
    rows = accounts.withColumn("is_copy", F.col("counter") != F.col("id")).select(*shaped.columns)
    return _long(shaped.unionByName(rows), "level")


def influence_of_nobody(fx: Fixture) -> DataFrame:
    """A study whose degree bound nobody reaches has no scores."""
    stored = study_inputs(fx)
    settings = VARIANTS["minmax_population"].but(min_degree=10**9)
    nobody = Study.of_accounts(stored.accounts, stored.network, stored.features(0), settings)
    kept = nobody.kept.agg(F.count(F.lit(1)).alias("kept")).scalar()
    return nobody.cosines.agg(F.count(F.lit(1)).alias("topics")).withColumn("kept", kept)


QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {
    function.__name__: function
    for function in (
        users_all, users_core, users_kept, users_loaded, users_loaded_set, user_set_sizes, users_periphery, user_degree, user_index,
        edges_core, edges_capped, random_people,
        features_loaded, features_by_tercile, features_var_norm, features_minmax_norm,
        vocab, topic_dictionary, unknown_topics, slice_topic_stats, slice_topic_stats_order_free, topics_kept,
        friend_topic_avg, random_topic_avg, population_topic_avg, topic_deltas, topic_cosine,
        topic_influence_order_free, topic_ols, friend_coefficient, influence_summary, influence_above_threshold, ols_export_lines,
        pipeline_counts, trust_scan, trust_core, trust_friend_avg, trust_diffs,
        ring_reach_count, core_members, core_messages, message_positions, positions_after_append, position_bounds, first_positions,
        user_first_messages, first_tercile_messages, first_tercile_by_bounds, tercile_sizes, message_parts,
        accounts_core, accounts_inserted, accounts_last_message, accounts_last_merged, network_core, edges_last_message,
        edges_last_bucketed, followers_bucketed,
        friend_messages, friend_message_key_dups,
        vocab_lines, positions_appended, accounts_reshaped, influence_of_nobody,
    )
}
QUERIES |= {
    "topic_influence": _influence(),
    "topic_influence_tercile1": _influence(tercile=1),
    "topic_influence_tercile2": _influence(tercile=2),
    "topic_influence_raw": _influence("raw_population"),
    "topic_influence_random": _influence("capped_random"),
    "topic_influence_trust": _influence("trust"),
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Fixture(spark, folder))
