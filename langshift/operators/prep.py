"""Data preparation: from a raw crawl to core messages, periods, enriched accounts and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langshift.operators import idsets
from langshift.operators.ranking import group_rank, running_total
from langshift.operators.skew import MIN_HOT_ROWS, fan_out_join, heavy_pairs
from langshift.operators.storage import materialise

# Crawl counters of the seed accounts, and the columns a core account keeps.
SEED_COUNTER = 74
RING_COUNTERS = (3, 74)
CORE_ACCOUNT_COLUMNS = (
    "id",
    "username",
    "last_message_id",
    "followers_count",
    "friends_count",
    "created_at",
    "favourites_count",
    "statuses_count",
)


# ---- core extraction ------------------------------------------------------------------------------


def reached_by(network: DataFrame, accounts: DataFrame, seeds: Column) -> DataFrame:
    """(dest_id): distinct accounts that the seed accounts follow."""
    sources = accounts.where(seeds).select(F.col("id").alias("source_id"))
    known = accounts.select(F.col("id").alias("dest_id"))
    followed = network.join(sources, "source_id", "left_semi").select("dest_id").distinct()
    return followed.join(known, "dest_id", "left_semi")


def ring_reach_count(network: DataFrame, accounts: DataFrame, low: int = 3, high: int = 74) -> DataFrame:
    """How many accounts those with low < counter < high follow.

    With dense ids the accounts followed and the accounts there are meet as bitmaps, one row for a range of ids.
    """
    seeds = (F.col("counter") > low) & (F.col("counter") < high)
    if not idsets.is_dense(accounts, "id"):
        return reached_by(network, accounts, seeds).agg(F.count_distinct("dest_id").alias("reached"))
    sources = accounts.where(seeds).select(F.col("id").alias("source_id"))
    followed = idsets.id_set(network.join(sources, "source_id", "left_semi"), "dest_id")
    sets = materialise(followed, "followed-set"), materialise(idsets.id_set(accounts, "id"), "account-set")
    return accounts.sparkSession.range(1).select(idsets.overlap(*sets).alias("reached"))


def core_members(network: DataFrame, accounts: DataFrame, max_counter: int = SEED_COUNTER) -> DataFrame:
    return reached_by(network, accounts, F.col("counter") <= max_counter)


def messages_of(messages: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """Messages written by the users in `column`."""
    return messages.join(users.select(F.col(column).alias("user_id")), "user_id", "left_semi")


def core_accounts(accounts: DataFrame, members: DataFrame) -> DataFrame:
    """One row per core member, the one with the smallest counter, without the crawl columns."""
    by_id = F.row_number().over(Window.partitionBy("id").orderBy("counter"))
    first = accounts.withColumn("_first", by_id).where("_first = 1").select(*CORE_ACCOUNT_COLUMNS)
    return first.join(members.select(F.col("dest_id").alias("id")), "id", "left_semi")


# ---- positions and periods ------------------------------------------------------------------------


def user_offsets(messages: DataFrame) -> DataFrame:
    """(user_id, n, before): each user's messages, and those of all users with smaller ids."""
    sizes = messages.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return running_total(sizes, [F.asc("user_id")], "n", "before")


def message_positions(messages: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Messages with `position`, their 1-based number in the order (user_id, message_id).

    The number is a rank inside the user plus the messages of earlier users, so no global sort is needed.
    """
    starts = user_offsets(messages).select("user_id", F.col("before").alias("start"))
    ranked = group_rank(messages, "user_id", "message_id", min_hot_rows, starts)
    return ranked.drop("n").withColumnRenamed("rn", "position")


def sorted_messages(messages: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The positioned messages laid out in position order, ready to be written as a sorted table."""
    return message_positions(messages, min_hot_rows).repartitionByRange("position").sortWithinPartitions("position")


def position_bounds(messages: DataFrame) -> DataFrame:
    """(user_id, min_, max_): first and last position of each user, from the counts alone."""
    return user_offsets(messages).select(
        "user_id", (F.col("before") + 1).alias("min_"), (F.col("before") + F.col("n")).alias("max_")
    )


def first_positions(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` messages in the order (user_id, message_id), numbered from 1."""
    top = messages.orderBy("user_id", "message_id").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("user_id", "message_id")).cast("long"))


def user_first_messages(messages: DataFrame, user_id: int, limit: int = 10) -> DataFrame:
    """The first `limit` messages of one user, numbered from 1."""
    return first_positions(messages.where(F.col("user_id") == user_id), limit)


def first_part(messages: DataFrame, parts: int = 3, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Messages at or before the first of `parts` equal cuts of their user's positions."""
    ranked = group_rank(messages, "user_id", "message_id", min_hot_rows)
    return ranked.where(parts * (F.col("rn") - 1) <= F.col("n") - 1).drop("rn", "n")


def first_tercile_by_bounds(positions: DataFrame, bounds: DataFrame) -> DataFrame:
    """The same from stored positions and bounds: position <= (2 min + max) / 3."""
    joined = positions.join(bounds, "user_id")
    return joined.where(3 * F.col("position") <= 2 * F.col("min_") + F.col("max_")).drop("min_", "max_")


def message_parts(messages: DataFrame, min_hot_rows: int = MIN_HOT_ROWS, **parts: int) -> DataFrame:
    """Messages with one column per period split, e.g. half=2, third=3, all from one ranking.

    Part k of p ends where p * (rank - 1) <= k * (n - 1) inside the user; parts are numbered from 1.
    """
    ranked = group_rank(messages, "user_id", "message_id", min_hot_rows)
    return ranked.withColumns({name: _part(number) for name, number in parts.items()}).drop("rn", "n")


def _part(parts: int) -> Column:
    """Smallest k whose cut lies at or after the rank."""
    cut = F.lit(parts) * (F.col("rn") - 1)
    number = F.ceil(cut / F.greatest(F.col("n") - 1, F.lit(1)))
    return F.greatest(number, F.lit(1)).cast("int")


def part_sizes(part: DataFrame) -> DataFrame:
    return part.groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"))


# ---- enrichment -----------------------------------------------------------------------------------


def with_last_messages(accounts: DataFrame, core_messages: DataFrame, all_messages: DataFrame) -> DataFrame:
    """Accounts with id and date of the last message and the last non-retweet; NULL when there is none."""

    def last(messages: DataFrame, id_name: str, date_name: str) -> DataFrame:
        return messages.groupBy(F.col("user_id").alias("id")).agg(
            F.max("message_id").alias(id_name), F.max("created_at").alias(date_name)
        )

    return (
        accounts.drop("last_message_id")
        .join(last(core_messages, "last_nrt_message_id", "last_nrt_message_date"), "id", "left")
        .join(last(all_messages, "last_message_id", "last_message_date"), "id", "left")
    )


def core_network(network: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges whose source is a core account; accounts are unique, so copies of edges stay as they are."""
    return network.join(accounts.select(F.col("id").alias("source_id")), "source_id")


def edges_with_last_messages(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges with their source account's last message ids."""
    last = accounts.select(F.col("id").alias("source_id"), "last_message_id", "last_nrt_message_id")
    return edges.join(last, "source_id", "left")


# ---- fan-out --------------------------------------------------------------------------------------


def friend_messages(edges: DataFrame, messages: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Every message once per follower of its author, with the keys of the follower.

    Much-followed and much-writing authors are both cut into pieces, so each pair of pieces is a task.
    """
    followers = edges.select("dest_id", F.col("source_id").alias("parent_id"))
    written = messages.withColumn("dest_id", F.col("user_id"))
    followers_hot, written_hot = heavy_pairs(followers, written, "dest_id", min_hot_rows)
    joined = fan_out_join(
        followers,
        written,
        "dest_id",
        left_hot=followers_hot,
        right_hot=written_hot,
        left_spread=("parent_id",),
        right_spread=("message_id",),
    )
    return joined.select(
        *(F.col(name) for name in messages.columns),
        "parent_id",
        F.concat_ws("_", "parent_id", "user_id").alias("parent_user_id"),
        F.concat_ws("_", "parent_id", "message_id").alias("parent_message_id"),
    )


def duplicate_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How many key values occur more than once."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return repeated.agg(F.count(F.lit(1)).alias("duplicate_keys"))
