import datetime as dt

import pytest

from langshift.operators import prep

MESSAGE = "message_id long, user_id long, created_at timestamp"
NETWORK = "source_id long, dest_id long"
ACCOUNT = (
    "id long, username string, level int, counter long, statuses_count long, recorded_friends_count long, "
    "followers_count long, friends_count long, favourites_count long, created_at timestamp, last_message_id long"
)


def day(number):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=number)


@pytest.fixture(scope="module")
def messages(spark):
    """Users 1..7 with as many messages, written in turn."""
    rows = [(100 * i + user, user) for user in range(1, 8) for i in range(user)]
    return spark.createDataFrame([(message, user, day(message)) for message, user in rows], MESSAGE)


def account(number, counter, name="n"):
    return (number, name, 1, counter, 10, 5, 1, 2, 3, day(0), 0)


@pytest.fixture(scope="module")
def crawl(spark):
    accounts = spark.createDataFrame(
        [account(1, 1), account(2, 50), account(3, 74), account(4, 75, "late"), account(4, 70, "early"), account(5, 900)], ACCOUNT
    )
    network = spark.createDataFrame([(1, 4), (1, 4), (1, 77), (2, 5), (3, 2), (4, 1), (5, 3), (4, 2)], NETWORK)
    return network, accounts


def sizes(frame):
    return {row.user_id: row.messages for row in prep.part_sizes(frame).collect()}


@pytest.mark.parametrize("min_hot_rows", [10**6, 1])
def test_first_tercile_sizes(messages, min_hot_rows):
    first = prep.first_part(messages, 3, min_hot_rows)
    assert sizes(first) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3}
    bounds = prep.position_bounds(messages)
    joined = prep.first_tercile_by_bounds(prep.message_positions(messages, min_hot_rows), bounds)
    assert {row.message_id for row in joined.collect()} == {row.message_id for row in first.collect()}


def test_cumulative_parts_are_not_ntile(messages):
    parted = prep.message_parts(messages, third=3, half=2)
    assert sizes(parted.where("third = 1")) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3}
    assert sizes(parted.where("third <= 2")) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 5}
    assert sizes(parted.where("half = 1")) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 4}


def test_positions_and_bounds(messages):
    positions = prep.message_positions(messages).collect()
    ordered = sorted(positions, key=lambda row: (row.user_id, row.message_id))
    assert [row.position for row in ordered] == list(range(1, 29))
    bounds = {row.user_id: (row.min_, row.max_) for row in prep.position_bounds(messages).collect()}
    assert bounds[1] == (1, 1) and bounds[4] == (7, 10) and bounds[7] == (22, 28)
    stored = prep.sorted_messages(messages).collect()
    assert [row.position for row in stored] == list(range(1, 29))


def test_first_positions(messages):
    assert [(row.user_id, row.position) for row in prep.first_positions(messages, 4).collect()] == [(1, 1), (2, 2), (2, 3), (3, 4)]
    one = prep.user_first_messages(messages, 7, 3).collect()
    assert [(row.message_id, row.position) for row in one] == [(7, 1), (107, 2), (207, 3)]


def test_core_extraction(crawl):
    network, accounts = crawl
    members = prep.core_members(network, accounts)
    assert {row.dest_id for row in members.collect()} == {1, 2, 4, 5}
    assert prep.ring_reach_count(network, accounts).first().reached == 3
    core = {row.id: row.username for row in prep.core_accounts(accounts, members).collect()}
    assert core == {1: "n", 2: "n", 4: "early", 5: "n"}
    assert "counter" not in prep.core_accounts(accounts, members).columns


def test_last_messages(spark, crawl):
    network, accounts = crawl
    core = prep.core_accounts(accounts, prep.core_members(network, accounts))
    everything = spark.createDataFrame([(7, 1, day(9)), (9, 1, day(3)), (8, 2, day(1))], MESSAGE)
    enriched = prep.with_last_messages(core, everything.where("message_id = 7"), everything)
    found = {row.id: row for row in enriched.collect()}
    assert (found[1].last_message_id, found[1].last_message_date) == (9, day(9))
    assert (found[1].last_nrt_message_id, found[2].last_nrt_message_id, found[2].last_message_id) == (7, None, 8)
    assert found[4].last_message_id is None
    edges = prep.core_network(network, core)
    assert edges.count() == 7
    last = {(row.source_id, row.dest_id): row.last_message_id for row in prep.edges_with_last_messages(edges, enriched).collect()}
    assert last[1, 4] == 9 and last[4, 1] is None


@pytest.mark.parametrize("min_hot_rows", [10**6, 1])
def test_fan_out(spark, crawl, min_hot_rows):
    network, _ = crawl
    written = spark.createDataFrame([(10 * user + i, user, day(i)) for user in (1, 2, 4) for i in range(5)], MESSAGE)
    copies = prep.friend_messages(network, written, min_hot_rows)
    assert copies.count() == 5 * 5
    row = copies.where("parent_id = 3").orderBy("message_id").first()
    assert (row.user_id, row.parent_user_id, row.parent_message_id) == (2, "3_2", "3_20")
    assert prep.duplicate_keys(copies, ("parent_id", "message_id")).first().duplicate_keys == 5
    assert prep.duplicate_keys(copies, ("parent_message_id",)).first().duplicate_keys == 5
