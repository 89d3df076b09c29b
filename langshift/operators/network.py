"""Follow edges.

`network` is a directed multigraph: a repeated row is a second edge and counts twice.  The study works on
*weighted* edges (source_id, dest_id, weight), one row per pair, so that copies are combined before
the first shuffle and no group of copies can grow large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langshift.functions.columns import hash60
from langshift.operators.users import core_of


def between(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Edges from core users to anybody in the study; copies are kept."""
    return from_core(to_known(edges, users), users)


def to_known(edges: DataFrame, users: DataFrame) -> DataFrame:
    return edges.join(users.select(F.col("id").alias("dest_id")), "dest_id", "left_semi")


def from_core(edges: DataFrame, users: DataFrame) -> DataFrame:
    return edges.join(core_of(users).select(F.col("id").alias("source_id")), "source_id", "left_semi")


def weighted(network: DataFrame) -> DataFrame:
    return network.groupBy("source_id", "dest_id").agg(F.count(F.lit(1)).alias("weight"))


def _copy_orders(cap: int, seed: int) -> Column:
    """The places in a random order of the first min(weight, cap) of an edge's copies, ascending.

    The smallest of w exponential numbers and the distances to the next ones are exponential again, with means 1 / w,
    1 / (w - 1) and so on, so the first few come without the others.
    """
    weight = F.col("weight")
    copies = F.sequence(F.lit(1).cast("long"), F.least(weight, F.lit(cap).cast("long")))

    def spacing(copy: Column) -> Column:
        uniform = (hash60(F.col("source_id"), F.col("dest_id"), copy, F.lit(seed)) + 1) / F.lit(float(1 << 60))
        return -F.log(uniform) / (weight - copy + 1)

    return F.transform(copies, lambda last: F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), last), spacing), F.lit(0.0), lambda a, x: a + x))


def cap_friends(edges: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` edges per source out of weighted edges, drawn uniformly without replacement; weighted.

    Every copy of an edge has a place of its own in a seeded random order, so an edge that occurs twice is
    twice as likely to be drawn; but an edge makes at most `cap` rows, whatever its weight.  The rank limit is
    applied before the shuffle as well, so at most `cap` rows per source and task move.
    """
    copies = edges.select("source_id", "dest_id", F.posexplode(_copy_orders(cap, seed)).alias("_copy", "_order"))
    drawn = F.row_number().over(Window.partitionBy("source_id").orderBy("_order", "dest_id", "_copy"))
    return weighted(copies.withColumn("_drawn", drawn).where(F.col("_drawn") <= cap))


def degrees(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every core user over weighted edges; 0 without edges."""
    counts = edges.groupBy(F.col("source_id").alias("id")).agg(F.sum("weight").alias("degree"))
    return core_of(users).join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
