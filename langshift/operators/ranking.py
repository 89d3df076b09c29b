"""Ranks and positions without a single-task sort.

`group_rank` numbers rows inside each key by one shuffle on the key; a key with too many rows is cut at
its own quantiles into consecutive parts that are ranked apart and then put end to end.  `dense_index`
and `running_total` number whole tables: the rows are range-sorted once and written, each written
partition is numbered on its own, and only one row per partition takes part in the final addition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langshift.operators.skew import MIN_HOT_ROWS, hot_keys
from langshift.operators.storage import materialise

QUANTILES = 1024  # so a key holding a third of all rows becomes a thousand parts
BLOCK = 32
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def _cut_points(frame: DataFrame, key: str, order: str, hot: DataFrame) -> DataFrame:
    """(key, cuts) for hot keys: cut points in blocks of BLOCK, about one per piece.

    All keys together have at most 2 * MAX_HOT cut points, so the table is always small.
    """
    steps = F.lit(np.arange(1, QUANTILES) / QUANTILES)
    quantiles = (
        frame.select(key, order)
        .join(F.broadcast(hot), key)
        .groupBy(key, "pieces")
        .agg(F.percentile_approx(order, steps, 20 * QUANTILES).alias("_quantiles"))
        .withColumn("_stride", F.greatest(F.lit(1), F.floor(QUANTILES / F.col("pieces"))).cast("int"))
    )
    every = F.filter("_quantiles", lambda _, i: (i + 1) % F.col("_stride") == 0)
    chosen = quantiles.select(key, F.array_distinct(every).alias("_chosen")).where(F.size("_chosen") > 0)
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("_chosen") / BLOCK).cast("int") - 1),
        lambda i: F.slice("_chosen", i * BLOCK + 1, F.lit(BLOCK)),
    )
    cuts = chosen.select(key, blocks.alias("_cuts"))
    return frame.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _part_number(order: str) -> Column:
    """How many cut points lie below the value: block first, then inside the block."""
    value = F.col(order)
    below = F.size(F.filter("_cuts", lambda block: F.element_at(block, -1) < value))
    inside = F.size(F.filter(F.get("_cuts", below), lambda cut: cut < value))
    return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(
        below * BLOCK + F.when(below < F.size("_cuts"), inside).otherwise(F.lit(0))
    )


def group_rank(
    frame: DataFrame, key: str, order: str, min_rows: int = MIN_HOT_ROWS, starts: DataFrame | None = None
) -> DataFrame:
    """Add `rn`, the 1-based rank by the numeric column `order` inside `key`, and `n`, the rows of the key.

    With `starts` (key, start) the ranks of a key begin after `start`.  The frame is shuffled once.
    """
    hot = hot_keys(frame, key, min_rows)
    if hot is None:
        by_key = Window.partitionBy(key)
        ranked = frame.select(
            "*",
            F.row_number().over(by_key.orderBy(order)).cast("long").alias("rn"),
            F.count(F.lit(1)).over(by_key).alias("n"),
        )
        return ranked if starts is None else _shift(ranked.join(starts, key), "start")
    return _rank_in_pieces(frame, key, order, hot, starts)


def _shift(ranked: DataFrame, amount: str) -> DataFrame:
    return ranked.withColumn("rn", F.col("rn") + F.col(amount)).drop(amount)


def _rank_in_pieces(frame: DataFrame, key: str, order: str, hot: DataFrame, starts: DataFrame | None) -> DataFrame:
    """`group_rank` with hot keys cut into consecutive parts; offsets have one row per key and part."""
    cuts = F.broadcast(_cut_points(frame, key, order, hot))
    parted = frame.join(cuts, key, "left").withColumn("_part", _part_number(order)).drop("_cuts")
    sizes = parted.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(key)
    earlier = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key,
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_key).alias("n"),
    )
    if starts is not None:
        offsets = offsets.join(starts, key).withColumn("_before", F.col("_before") + F.col("start")).drop("start")
    rank = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)).cast("long")
    return _shift(parted.withColumn("rn", rank).join(offsets, [key, "_part"]), "_before").drop("_part")


def _sorted_parts(frame: DataFrame, order: list[Column]) -> DataFrame:
    """The frame range-sorted and written, with the partition and row number each row was written at."""
    numbered = materialise(frame.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    return numbered.select(
        *frame.columns,
        F.shiftright("_id", _ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def _part_offsets(parts: DataFrame, amount: Column) -> DataFrame:
    """Total of `amount` in all earlier partitions; one row per sort partition, hence broadcastable."""
    totals = parts.groupBy("_part").agg(amount.alias("_amount"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_amount").over(earlier), F.lit(0))
    return F.broadcast(totals.select("_part", before.alias("_offset")))


def dense_index(frame: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Add a 0-based consecutive number in the given order.  The order must be total."""
    parts = _sorted_parts(frame, order)
    offsets = _part_offsets(parts, F.count(F.lit(1)))
    return parts.join(offsets, "_part").select(*frame.columns, (F.col("_offset") + F.col("_row")).alias(name))


def running_total(frame: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the sum of `value` over all earlier rows in the given order."""
    parts = _sorted_parts(frame, order)
    offsets = _part_offsets(parts, F.sum(value))
    earlier = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("_inside", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return inside.join(offsets, "_part").select(*frame.columns, (F.col("_offset") + F.col("_inside")).alias(name))
