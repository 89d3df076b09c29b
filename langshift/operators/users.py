"""User sets: the core, everybody, the loaded users and the periphery."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.config import Variant
from langshift.operators.ranking import dense_index


def _account_filter(level: int | None, statuses: int | None, friends: int | None) -> Column:
    bounds = {"level": (level, "__le__"), "statuses_count": (statuses, "__ge__"), "recorded_friends_count": (friends, "__ge__")}
    tests = [getattr(F.col(name), test)(bound) for name, (bound, test) in bounds.items() if bound is not None]
    return reduce(and_, tests, F.lit(True))


def select_users(
    accounts: DataFrame, level: int | None, statuses: int | None = None, friends: int | None = None
) -> DataFrame:
    """Distinct ids of the accounts within the crawl level and above the activity thresholds."""
    return accounts.where(_account_filter(level, statuses, friends)).select("id").distinct()


def study_users(accounts: DataFrame, variant: Variant) -> DataFrame:
    """(id, is_core): everybody in the study, both sets from one pass over the accounts.

    A test on a NULL fails, so with `min_recorded` an account whose friends were never counted is out.
    """
    everybody = _account_filter(variant.all_level, variant.min_statuses, variant.min_recorded)
    core = _account_filter(variant.core_level, variant.min_statuses, variant.min_friends)
    return (
        accounts.where(everybody | core)
        .groupBy("id")
        .agg(F.bool_or(F.coalesce(core, F.lit(False))).alias("is_core"))
    )


def trust_users(scores: DataFrame) -> DataFrame:
    """(id, is_core): all scored users; those with more than one friend are core."""
    core = F.coalesce(F.col("num_of_friends") > 1, F.lit(False))
    return scores.select(F.col("user_id").alias("id"), core.alias("is_core"))


def core_of(users: DataFrame) -> DataFrame:
    return users.where("is_core").select("id")


def periphery_of(users: DataFrame) -> DataFrame:
    """Everybody who is not core."""
    return users.select("id").join(core_of(users), "id", "left_anti")


def loaded_users(users: DataFrame, edges: DataFrame) -> DataFrame:
    """Core users and everybody a core edge leads to."""
    return core_of(users).union(edges.select(F.col("dest_id").alias("id"))).distinct()


def loaded_flags(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_core) of the loaded users."""
    followed = edges.select(F.col("dest_id").alias("id"), F.lit(False).alias("is_core"))
    flagged = core_of(users).withColumn("is_core", F.lit(True)).unionByName(followed)
    return flagged.groupBy("id").agg(F.bool_or("is_core").alias("is_core"))


def user_index(users: DataFrame) -> DataFrame:
    """0-based index, core users first."""
    return dense_index(users, [F.desc("is_core"), F.asc("id")], "user_index")
