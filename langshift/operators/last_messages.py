"""The last message of every account as a table that new messages are merged into.

A batch of messages is reduced to one row per account and appended; old messages, and what is stored of them, are not
read again.  A maximum of maxima is the maximum, so batches may come in any number and order, late or more than once.
Reading merges what was appended; `compact` writes the merged table anew when many batches have piled up.

Messages without an account belong to nobody; a null id or date counts as none; an account without messages has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("last_message_id", "last_message_date")


def last_of(messages: DataFrame) -> DataFrame:
    """(user_id, last_message_id, last_message_date) of the accounts that wrote the messages."""
    named = messages.where(F.col("user_id").isNotNull()).groupBy("user_id")
    return named.agg(F.max("message_id").alias(COLUMNS[0]), F.max("created_at").alias(COLUMNS[1]))


def merged(*tables: DataFrame) -> DataFrame:
    """One row per account out of several such tables."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("user_id").agg(*[F.max(name).alias(name) for name in COLUMNS])


def add_messages(messages: DataFrame, path: str) -> None:
    """Merge a batch of messages into the stored table."""
    last_of(messages).write.mode("append").parquet(path)


def read_last(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.parquet(path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the stored table with one row per account to a new place; the old one may then be dropped."""
    read_last(spark, path).write.parquet(target)


def with_stored_last(accounts: DataFrame, nrt: DataFrame, everything: DataFrame) -> DataFrame:
    """Accounts with id and date of the last message and the last non-retweet out of stored tables; NULL without any."""
    own = nrt.select(F.col("user_id").alias("id"), *[F.col(c).alias(c.replace("last_", "last_nrt_")) for c in COLUMNS])
    every = everything.select(F.col("user_id").alias("id"), *COLUMNS)
    return accounts.drop("last_message_id").join(own, "id", "left").join(every, "id", "left")
