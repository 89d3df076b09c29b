"""Sets of whole-number ids as exact bitmaps, one row for each range of 32,768 ids.

A set is a table (bucket, bitmap).  Ids are counted and combined without being moved one by one: partial bitmaps of a
range are merged wherever rows of it lie, so what is shuffled is bounded by ranges times tasks.  Zero and negative ids
have ranges of their own.  Bitmaps pay where ids are dense; `is_dense` measures that, and for sparse ids (a range would
hold a handful) a distinct is the better set.

Null ids are in no set; repeated ids count once; an empty table is the empty set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = 32_768  # ids of a bitmap, which takes 4,096 bytes
DENSE = 512  # ids of a range from which its bitmap is smaller than they are


def _range_of(column: str) -> Column:
    return F.bitmap_bucket_number(F.col(column).cast("long"))


def is_dense(rows: DataFrame, column: str) -> bool:
    """Whether ranges that hold an id hold DENSE of them on average; one pass with small sketches."""
    ids, ranges = rows.agg(F.approx_count_distinct(column), F.approx_count_distinct(_range_of(column))).first()
    return ids >= DENSE * ranges


def id_set(rows: DataFrame, column: str) -> DataFrame:
    """(bucket, bitmap) of the distinct ids in a column."""
    place = F.bitmap_bit_position(F.col(column).cast("long"))
    ranges = rows.where(F.col(column).isNotNull()).groupBy(_range_of(column).alias("bucket"))
    return ranges.agg(F.bitmap_construct_agg(place).alias("bitmap"))


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def size(ids: DataFrame) -> Column:
    """How many ids a set has, as a scalar subquery."""
    return ids.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n")).scalar()


def overlap(left: DataFrame, right: DataFrame) -> Column:
    """How many ids two sets share: both sizes less that of the union."""
    return size(left) + size(right) - size(union(left, right))


def members(ids: DataFrame, name: str = "id") -> DataFrame:
    """The ids of a set, in a column."""
    at = F.explode(F.sequence(F.lit(0), F.lit(RANGE // 8 - 1))).alias("at")
    digits = F.hex("bitmap")
    byte = F.conv(F.substr(digits, F.col("at") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    filled = ids.select("bucket", "bitmap", at).select("bucket", "at", byte.alias("byte")).where("byte <> 0")
    bits = filled.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    bits = bits.where(F.expr("shiftright(byte, bit) & 1 = 1")).withColumn("place", (F.col("at") * 8 + F.col("bit")).cast("long"))
    above = (F.col("bucket") - 1) * RANGE + F.col("place") + 1
    return bits.select(F.when(F.col("bucket") > 0, above).otherwise(F.col("bucket") * RANGE - F.col("place")).alias(name))
