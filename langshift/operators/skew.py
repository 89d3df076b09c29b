"""Joins and groups that stay balanced when one key holds a large part of all rows.

A key is *hot* when it holds more than 1/MAX_HOT of all rows (and more than `min_rows`).  There can be
at most MAX_HOT such keys whatever the data, so the list of hot keys always fits the driver and may
always be broadcast.  It is measured first; without hot keys the plain join or window is planned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_HOT = 4096
MIN_HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
SPREAD = 256


def hot_keys(frame: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame | None:
    """(key, pieces) of every hot key: into how many pieces its rows should be cut.  None without any.

    The usual case is one job over the key column with partial counts; at most MAX_HOT rows come back.
    """
    counts = frame.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    share = max(min_rows, math.ceil((total or 0) / MAX_HOT))
    if (largest or 0) <= share:
        return None
    hot = counts.where(F.col("_rows") > share).select(key, F.ceil(F.col("_rows") / share).cast("int").alias("pieces"))
    schema = T.StructType([frame.schema[key], T.StructField("pieces", T.IntegerType(), True)])
    return frame.sparkSession.createDataFrame(hot.collect(), schema)


def heavy_pairs(
    left: DataFrame, right: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS
) -> tuple[DataFrame | None, DataFrame | None]:
    """(key, pieces) for each side of a join on `key`, by the rows that a key makes: left times right.

    A key that makes more than 1/MAX_HOT of all rows (and over `min_rows`) is cut into pieces of about that
    size, on its longer side first.  There can be at most MAX_HOT such keys.  (None, None) without any.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_left"))
    pairs = counts.join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_right")), key)
    pairs = pairs.withColumn("_made", F.col("_left").cast("double") * F.col("_right"))
    total, largest = pairs.agg(F.sum("_made"), F.max("_made")).first()
    share = max(min_rows, math.ceil((total or 0) / MAX_HOT))
    if (largest or 0) <= share:
        return None, None
    cuts = F.ceil(F.col("_made") / share)
    longer = F.least(cuts, F.greatest("_left", "_right"))
    shorter = F.ceil(cuts / longer)
    by_left = F.col("_left") >= F.col("_right")
    heavy = pairs.where(F.col("_made") > share).select(
        key,
        F.when(by_left, longer).otherwise(shorter).cast("int").alias("_left"),
        F.when(by_left, shorter).otherwise(longer).cast("int").alias("_right"),
    )
    found = heavy.collect()
    schema = T.StructType([left.schema[key], T.StructField("pieces", T.IntegerType(), True)])
    sides = ([(row[key], row[side]) for row in found if row[side] > 1] for side in ("_left", "_right"))
    left_hot, right_hot = (left.sparkSession.createDataFrame(rows, schema) if rows else None for rows in sides)
    return left_hot, right_hot


def fan_out_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_hot: DataFrame | None = None,
    right_hot: DataFrame | None = None,
    left_spread: tuple[str, ...] = (),
    right_spread: tuple[str, ...] = (),
) -> DataFrame:
    """Inner join on `key` in which a hot key becomes a grid of tasks instead of one.

    A row of a side with a hot key goes to one of the key's pieces, chosen by a hash of the spread
    columns, and the other side's rows of that key are copied to each piece.  Every pair still meets
    exactly once, and rows of ordinary keys are neither salted nor copied.

    The left side gets the session's full number of shuffle partitions and is never broadcast: its rows
    are few and narrow beside the rows the join makes of them, so tasks sized by input would be huge.
    """
    for number, (hot, spread) in enumerate(((left_hot, left_spread), (right_hot, right_spread))):
        if hot is None:
            continue
        salt = f"_salt{number}"
        hot = F.broadcast(hot)
        piece = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("pieces")), F.lit(0)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1))
        split, copied = (left, right) if number == 0 else (right, left)
        split = split.join(hot, key, "left").withColumn(salt, piece).drop("pieces")
        copied = copied.join(hot, key, "left").withColumn(salt, copies).drop("pieces")
        left, right = (split, copied) if number == 0 else (copied, split)
    salts = [name for name in ("_salt0", "_salt1") if name in left.columns]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, key, *salts).hint("merge").join(right, [key, *salts]).drop(*salts)


def looked_up(table: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table of small rows, at most about `rows`, that others are joined with by a key it holds once.

    Beyond `limit` it is shuffled and hashed in parts.  The planner takes the size of files for that of a table, but Parquet
    packs a column of ids to a fraction of what they take as the hash table that the driver builds for a broadcast.
    """
    return table.hint("shuffle_hash") if rows > limit else table


def attach_small(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    table_rows: int,
    spread: tuple[str, ...],
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of many rows with a table unique on `key` whose size was measured beforehand.

    Up to `limit` rows the table is broadcast.  Beyond that it is copied to SPREAD salts and the rows
    are shuffled on (key, salt), so that a frequent key is still shared by many tasks.
    """
    if table_rows <= limit:
        return rows.join(F.broadcast(table), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SPREAD)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")
