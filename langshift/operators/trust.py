"""Trust scores averaged over friends and over drawn people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langshift.functions.columns import is_finite, nan_to_null


def score_average(links: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """(source_id, name): weighted mean of wo_retweets over the linked users, skipping missing scores.

    NULL when no linked user has a score.
    """
    value = nan_to_null(F.col("wo_retweets"))
    known = scores.select(F.col("user_id").alias("dest_id"), value.alias("_score"))
    weight = F.when(F.col("_score").isNotNull(), F.col("weight"))
    joined = links.join(known, "dest_id")
    return joined.groupBy("source_id").agg(
        F.try_divide(F.sum(F.col("_score") * F.col("weight")), F.sum(weight)).alias(name)
    )


def averaged_users(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, avg_friends) of core users with a finite own score change and a known friend average."""
    core = scores.where((F.col("num_of_friends") > 1) & is_finite(F.col("diff_score"))).select("user_id")
    friends = score_average(edges, scores, "avg_friends").where(F.col("avg_friends").isNotNull())
    return core.join(friends.withColumnRenamed("source_id", "user_id"), "user_id")


def trust_differences(scores: DataFrame, averaged: DataFrame, draws: DataFrame) -> DataFrame:
    """All scored users with the averages and their distance from the user's own first part."""
    people = score_average(draws.withColumn("weight", F.lit(1)), scores, "avg_random_people")
    return (
        scores.select("user_id", "num_of_friends", "first_part", "diff_score")
        .join(averaged, "user_id", "left")
        .join(people.withColumnRenamed("source_id", "user_id"), "user_id", "left")
        .withColumn("diff_friends", F.col("avg_friends") - F.col("first_part"))
        .withColumn("diff_random_people", F.col("avg_random_people") - F.col("first_part"))
    )
