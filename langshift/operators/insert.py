"""Rows added to a stored table unless it has their key: the first row of every key stays.

Of the rows of one batch with the same key the first in a stated order counts, so batches cut along that order give
the same table in any number.  Stored keys are checked exactly, by an anti join; a Bloom filter of the batch's keys goes
before it, so that of a large stored table only the rows that a batch could meet are moved.

Rows with a null key are left out, as a primary key holds no null; ties of the order are broken by all columns' hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langshift.operators.storage import materialise

BITS_PER_KEY = 10
HASHES = 5
WORD = 64
FILTER_BYTES = 16 << 20  # a filter beyond this is not built; the anti join alone is as exact


def first_rows(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key of the batch, the first by `order`."""
    place = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), F.xxhash64(*batch.columns))
    ranked = batch.where(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(place))
    return ranked.where("_place = 1").drop("_place")


def key_filter(keys: DataFrame, key: str, rows: int) -> Column | None:
    """A condition on `key` that holds for every one of these keys and few others; None if it would be too large."""
    bits = -(-max(1, rows * BITS_PER_KEY) // WORD) * WORD
    if bits // 8 > FILTER_BYTES:
        return None
    places = [F.pmod(F.xxhash64(F.col(key), F.lit(number)), F.lit(bits)) for number in range(HASHES)]
    mask = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(WORD)).cast("int"))
    marks = keys.select(F.explode(F.array(*places)).alias("place"))
    marks = marks.select(F.floor(F.col("place") / WORD).cast("long").alias("word"), mask(F.col("place")).alias("mask"))
    empty = keys.sparkSession.range(bits // WORD).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = marks.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    packed = words.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("all")).select(F.col("all.mask").alias("words"))
    stored = materialise(packed, "key-filter").scalar()
    tests = [F.get(stored, F.floor(place / WORD).cast("int")).bitwiseAND(mask(place)) != 0 for place in places]
    return reduce(lambda a, b: a & b, tests)


def new_rows(batch: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """The batch's first rows whose key the stored table does not have."""
    first = materialise(first_rows(batch, key, order), "insert-first")
    known = stored.select(key)
    condition = key_filter(first.select(key), key, first.count())
    if condition is not None:
        known = known.where(condition)
    return first.join(known, key, "left_anti")


def insert_ignore(spark: SparkSession, batch: DataFrame, path: str, key: str, order: str, exists: bool = True) -> None:
    """Append the new rows of a batch to the table at `path`."""
    rows = new_rows(batch, spark.read.parquet(path), key, order) if exists else first_rows(batch, key, order)
    materialise(rows, "insert-new").write.mode("append").parquet(path)
