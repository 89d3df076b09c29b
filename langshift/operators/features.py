"""Topic scores per user: slices, vocabulary, zero-filled statistics and normalisation.

A user without a row for a topic has score 0 there.  These zeros are never written out: each statistic
adds them by arithmetic from the number of rows present and the number of users N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.operators.ranking import dense_index
from langshift.operators.users import core_of

SLICES = (0, 1, 2)
REFERENCE_SLICE = 2


def restrict_features(features: DataFrame, users: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows that take part: core users in slices 0 and 1, loaded users in the reference slice."""
    core_rows = features.where(F.col("slice") < REFERENCE_SLICE).join(
        core_of(users).select(F.col("id").alias("group_id")), "group_id", "left_semi"
    )
    reference_rows = features.where(F.col("slice") == REFERENCE_SLICE).join(
        loaded.select(F.col("id").alias("group_id")), "group_id", "left_semi"
    )
    return core_rows.unionByName(reference_rows)


def _score(slice_number: int) -> Column:
    """Score of a slice; among several rows for one cell the one with the largest id counts."""
    return F.max_by("group_norm", F.when(F.col("slice") == slice_number, F.col("id")))


def cells(features: DataFrame, loaded: DataFrame) -> DataFrame:
    """(group_id, feat, s0, s1, s2): s0 and s1 of core users, s2 of all `loaded` (id, is_core); NULL where a slice has no row.

    The users are looked up first, so that rows of others are neither aggregated nor, when the users fit a
    broadcast, shuffled.  All slices go through one join and one aggregation.
    """
    flagged = loaded.select(F.col("id").alias("group_id"), "is_core")
    rows = features.join(flagged, "group_id").where((F.col("slice") == REFERENCE_SLICE) | F.col("is_core"))
    return rows.groupBy("group_id", "feat").agg(*(_score(number).alias(f"s{number}") for number in SLICES))


def core_cells(every: DataFrame) -> DataFrame:
    """(group_id, feat, s0, s1) of core users that have a score in one of both slices."""
    return every.where("s0 IS NOT NULL OR s1 IS NOT NULL").select("group_id", "feat", "s0", "s1")


def reference_cells(every: DataFrame) -> DataFrame:
    """(group_id, feat, s2) of loaded users that have a reference score."""
    return every.where("s2 IS NOT NULL").select("group_id", "feat", "s2")


def vocabulary(features: DataFrame, scope: str = "all") -> DataFrame:
    """Distinct topics of every slice, or of slice 0 only (scope "first")."""
    rows = features.where(F.col("slice") == 0) if scope == "first" else features
    return rows.select("feat").distinct()


def topic_dictionary(features: DataFrame, scope: str = "all") -> DataFrame:
    """(feat, topic_id): 1-based, by first slice the topic occurs in, then by name."""
    rows = features.where(F.col("slice") == 0) if scope == "first" else features
    first_seen = rows.groupBy("feat").agg(F.min("slice").alias("first_slice"))
    numbered = dense_index(first_seen, [F.asc("first_slice"), F.asc("feat")], "_index")
    return numbered.select("feat", "first_slice", (F.col("_index") + 1).alias("topic_id"))


def unknown_topics(rows: DataFrame, known: DataFrame) -> DataFrame:
    """How many topics, and rows of them, occur among the rows but not in the vocabulary."""
    per_topic = rows.groupBy("feat").agg(F.count(F.lit(1)).alias("rows"))
    missing = per_topic.join(known, "feat", "left_anti")
    return missing.agg(
        F.count(F.lit(1)).alias("unknown_topics"), F.coalesce(F.sum("rows"), F.lit(0)).alias("unknown_rows")
    )


def _sums(cells: DataFrame, slices: tuple[int, ...]) -> DataFrame:
    aggregates = []
    for number in slices:
        score = F.col(f"s{number}")
        aggregates += [
            F.count(score).alias(f"rows{number}"),
            F.sum(score).alias(f"sum{number}"),
            F.var_pop(score).alias(f"spread{number}"),
            F.min(score).alias(f"min{number}"),
            F.max(score).alias(f"max{number}"),
        ]
    return cells.groupBy("feat").agg(*aggregates)


def topic_statistics(core: DataFrame, reference: DataFrame, people: Column) -> DataFrame:
    """One row per topic: mean, population variance, min and max of each slice over all N users.

    A topic without rows in a slice is 0 for everybody there.
    """
    return zero_filled(_sums(core, (0, 1)).join(_sums(reference, (2,)), "feat", "full_outer").withColumn("n", people))


def zero_filled(wide: DataFrame) -> DataFrame:
    """The statistics of all n users from count, sum, variance, min and max of the rows of each slice.

    The variance is that of the k rows, taken about their own mean, merged with that of n - k zeros, so no large
    numbers are subtracted.
    """
    columns = [F.col("feat"), F.col("n")]
    for number in SLICES:
        rows = F.coalesce(f"rows{number}", F.lit(0))
        total = F.coalesce(F.col(f"sum{number}"), F.lit(0.0))
        mean = total / F.col("n")
        own = rows / F.col("n") * F.coalesce(F.col(f"spread{number}"), F.lit(0.0))
        apart = F.when(rows > 0, mean * (total / F.greatest(rows, F.lit(1))) * (F.col("n") - rows) / F.col("n"))
        spread = own + F.coalesce(apart, F.lit(0.0))
        has_zero = rows < F.col("n")
        low, high = F.col(f"min{number}"), F.col(f"max{number}")
        columns += [
            rows.alias(f"rows{number}"),
            mean.alias(f"mean{number}"),
            spread.alias(f"var{number}"),
            F.when(has_zero, F.least(low, F.lit(0.0))).otherwise(low).alias(f"min{number}"),
            F.when(has_zero, F.greatest(high, F.lit(0.0))).otherwise(high).alias(f"max{number}"),
        ]
    return wide.select(*columns)


def slice_statistics(statistics: DataFrame) -> DataFrame:
    """The statistics in long form, one row per (slice, topic)."""
    names = ("rows", "mean", "var", "min", "max")
    entries = [
        F.struct(F.lit(number).alias("slice"), *(F.col(f"{name}{number}").alias(name) for name in names))
        for number in SLICES
    ]
    return statistics.select("feat", F.explode(F.array(*entries)).alias("entry")).select("feat", "entry.*")


def varying_topics(statistics: DataFrame) -> DataFrame:
    """Topics that are not constant in any slice.

    Tested by the range rather than by the variance, which rounding can keep from being exactly zero.
    """
    kept = statistics
    for number in SLICES:
        kept = kept.where(F.col(f"max{number}") > F.col(f"min{number}"))
    return kept


def _divisor(spread: Column) -> Column:
    return F.when(spread > 0, spread).otherwise(F.lit(1.0))


def scale_of(method: str | None) -> tuple[Column, Column]:
    """(shift, divisor) of a normalisation; both come from the reference slice.

    A spread too small for a double divides by 1.
    """
    if method is None:
        return F.lit(0.0), F.lit(1.0)
    if method == "minmax":
        return F.col("min2"), _divisor(F.col("max2") - F.col("min2"))
    if method == "variance":
        return F.col("mean2"), _divisor(F.col("var2"))
    raise ValueError(f"unknown normalisation: {method}")


def topic_scales(topics: DataFrame, method: str | None) -> DataFrame:
    """(feat, topic, shift, divisor, base_avg, cells) of the varying topics; base_avg is the mean over all N users, of
    whom `cells` have a reference score.

    `topic` is a number that stands for the name in wide shuffles.  It is fixed once the table is written.
    """
    shift, divisor = scale_of(method)
    return topics.select(
        "feat",
        F.monotonically_increasing_id().alias("topic"),
        shift.alias("shift"),
        divisor.alias("divisor"),
        F.col("mean2").alias("base_avg"),
        F.col("rows2").alias("cells"),
    )
