"""Messages kept with their positions, so that later messages are numbered without sorting all of them again.

The stored table is cut into ranges of users, a folder each, in which a message has its rank inside the range.  A fence
table, one row per range, holds its last user and its number of messages; the position of a message is its rank plus the
messages of earlier ranges.  An append reads and writes only the ranges that its messages fall into, and a reader of
one user's messages, or of a stretch of positions, reads only the ranges that hold them.

Both tables are versions: an append leaves the fences of the old version until its own are complete.  A range that has
grown much beyond the others stays exact; `write_positions` lays the table out anew.  Messages without a user are the
first range's; message ids must be unique, as positions follow (user_id, message_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langshift.operators.prep import message_positions
from langshift.operators.storage import materialise

RANGES = 64
MOST_RANGES = 4096


@dataclass(frozen=True)
class Positioned:
    """A stored table of messages by ranges, and its fences (range, last_user, rows), at most MOST_RANGES of them."""

    path: str
    fences: DataFrame
    schema: T.StructType  # of the messages

    def stored(self) -> DataFrame:
        """The messages with the range they lie in and their rank inside it."""
        schema = T.StructType([*self.schema.fields, T.StructField("rank", T.LongType()), T.StructField("range", T.IntegerType())])
        return self.fences.sparkSession.read.schema(schema).parquet(self.path)

    def offsets(self) -> DataFrame:
        """(range, before): messages of all earlier ranges; one row per range, hence broadcast."""
        earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        return F.broadcast(self.fences.select("range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")))

    def read(self, ranges: list[int] | None = None) -> DataFrame:
        """The messages with their positions, of all ranges or of some."""
        rows = self.stored()
        if ranges is not None:
            rows = rows.where(F.col("range").isin(ranges))
        joined = rows.join(self.offsets(), "range")
        return joined.withColumn("position", F.col("rank") + F.col("before")).drop("rank", "before", "range")

    def of_user(self, user_id: int) -> DataFrame:
        """One user's messages, from the range that holds them."""
        cuts = _cuts(self.fences)
        return self.read([sum(cut < user_id for cut in cuts)]).where(F.col("user_id") == user_id)

    def stretch(self, first: int, last: int) -> DataFrame:
        """Messages whose positions lie within the bounds, from the ranges that hold them."""
        ends = self.fences.join(self.offsets(), "range").where((F.col("before") < last) & (F.col("before") + F.col("rows") >= first))
        wanted = [r["range"] for r in ends.select("range").collect()]
        return self.read(wanted).where(F.col("position").between(first, last))


def _cuts(fences: DataFrame) -> list[int]:
    """Last users of all ranges but the last, ascending."""
    return [r["last_user"] for r in fences.where("last_user is not null").orderBy("range").select("last_user").collect()]


def _range_of(cuts: list[int]) -> Column:
    """How many cuts lie below the user, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("user_id") > cuts[middle], between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts)).cast("int")


def _write_ranges(rows: DataFrame, path: str, mode: str) -> DataFrame:
    """Rank rows that carry their range inside it and write them; (range, rows) of what was written."""
    sizes = materialise(rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows")), "range-sizes")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(sizes.select("range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_before")))
    ranked = message_positions(rows).join(before, "range")  # ranges ascend with users, so positions do with ranges
    ranked = ranked.withColumn("rank", F.col("position") - F.col("_before")).drop("position", "_before")
    staged = materialise(ranked, "ranked")
    writer = staged.repartition("range").sortWithinPartitions("range", "rank").write.partitionBy("range").mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return sizes


def write_positions(messages: DataFrame, path: str, ranges: int = RANGES) -> Positioned:
    """Lay all messages out in ranges of about equal size."""
    spark, messages = messages.sparkSession, messages.where(F.col("user_id").isNotNull())
    steps = [k / ranges for k in range(1, min(ranges, MOST_RANGES))]
    cuts = sorted(set(messages.agg(F.percentile_approx("user_id", steps, 100 * ranges)).first()[0] or []))
    sizes = _write_ranges(messages.withColumn("range", _range_of(cuts)), path, "overwrite")
    fences = [(number, cut) for number, cut in enumerate([*cuts, None])]
    table = spark.createDataFrame(fences, "range int, last_user long").join(sizes, "range", "left")
    return Positioned(path, materialise(table.select("range", "last_user", F.coalesce("rows", F.lit(0)).alias("rows")), "fences"), messages.schema)


def append_positions(stored: Positioned, messages: DataFrame) -> tuple[Positioned, list[int]]:
    """Number new messages; the ranges that were read and written come back too."""
    known = messages.where(F.col("user_id").isNotNull())
    new = materialise(known.withColumn("range", _range_of(_cuts(stored.fences))), "new-messages")
    touched = sorted(r["range"] for r in new.select("range").distinct().collect())  # at most MOST_RANGES
    if not touched:
        return stored, []
    old = stored.stored().where(F.col("range").isin(touched)).drop("rank")
    sizes = _write_ranges(materialise(old.select(*new.columns).unionByName(new), "touched"), stored.path, "overwrite")
    fences = stored.fences.join(sizes.withColumnRenamed("rows", "_rows"), "range", "left")
    fences = fences.select("range", "last_user", F.coalesce("_rows", "rows").alias("rows"))
    return Positioned(stored.path, materialise(fences, "fences"), stored.schema), touched
