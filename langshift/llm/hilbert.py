"""Sharding in Hilbert-curve order, with built-in expressions only.

Several metadata columns, texts by their rank among all distinct ones, are quantised by their quantiles over all rows,
the cell's index on the Hilbert curve is computed, and the rows in curve order are cut into runs of equal counts.  Rows
of a shard are close in all dimensions at once, so the minima and maxima in its file footer let readers skip the file
on a filter on any of them.

Defined results: nulls in a dimension have its lowest level to themselves; ties on the curve are ordered by the checksum
of the text (equal texts of a cell stay together), then by id and size; repeated rows are rows of their own, and as many
as there may be are sorted by many tasks, since a row number comes last in the order; a null text has size 16 and no
checksum; very long texts only count their bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langshift.operators.ranking import dense_index
from langshift.operators.storage import materialise

ROW_BYTES = 16  # counted for every row beside its text
BITS = 5  # levels of each dimension: 2 ** BITS
BROADCAST_TEXTS = 4096  # distinct texts of a dimension up to which their ranks are broadcast
ACCURACY = 20_000  # of the quantile sketch: rank error is one part in so many
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")


LOWEST = float("-inf")  # stands for null: below every number


def with_ranks(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a text column replaced by its rank among the distinct texts of the whole table; null stays null."""
    distinct = materialise(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_of")).distinct(), "hilbert-texts")
    ranks = materialise(dense_index(distinct, [F.col("_of")], "_place"), "hilbert-ranks")
    if ranks.count() <= BROADCAST_TEXTS:
        ranks = F.broadcast(ranks)
    joined = rows.join(ranks, F.col(column) == F.col("_of"), "left")
    return joined.withColumn(column, F.col("_place")).drop("_of", "_place")


def quantile_cuts(numbers: DataFrame, bits: int) -> dict[str, list[float]]:
    """For each column at most 2 ** bits - 1 ascending cut points, from one pass over all rows.

    The cuts are quantiles of what is not null; where there are nulls, the first cut sets LOWEST apart.
    """
    steps = [k / 2**bits for k in range(1, 2**bits)]
    quantiles = [F.percentile_approx(c, steps, ACCURACY) for c in numbers.columns]
    found = numbers.agg(F.array(*quantiles), F.array(*[F.count_if(F.isnull(c)) for c in numbers.columns])).first()
    cuts = {c: sorted(set(q or [])) for c, q in zip(numbers.columns, found[0], strict=True)}
    for c, nulls in zip(numbers.columns, found[1], strict=True):
        if nulls:
            cuts[c] = [LOWEST, *cuts[c][max(0, len(cuts[c]) - len(steps) + 1) :]]
    return cuts


def level(value: Column, cuts: list[float]) -> Column:
    """How many cut points lie below the value, by halving."""

    def between(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(value > cuts[middle], between(middle + 1, last)).otherwise(between(first, middle))

    return between(0, len(cuts))


def with_hilbert_index(frame: DataFrame, levels: list[Column], bits: int, name: str) -> DataFrame:
    """Add the index on the Hilbert curve through a grid of len(levels) dimensions with 2 ** bits levels each.

    The coordinates become the curve's transposed index: at each bit, from the highest, each dimension
    either flips the lower bits of the first one or swaps them with its own; a Gray code follows, and
    the bits are interleaved.
    """
    n = len(levels)
    high = [1 << b for b in range(bits - 1, -1, -1)]
    dims = F.array(*[F.lit(i) for i in range(n)])

    def pairs(bit_values: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in bit_values for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        own, first, low = F.get(x, step["i"]), F.get(x, F.lit(0)), step["q"] - 1
        flip = own.bitwiseAND(step["q"]) != 0
        swap = own.bitwiseXOR(first).bitwiseAND(low)
        new_first = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(flip, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(
            dims, lambda d: F.when(d == 0, new_first).when(d == step["i"], new_own).otherwise(F.get(x, d))
        )

    def gray(done: Column, d: Column) -> Column:
        before = F.when(d == 0, F.lit(0)).otherwise(F.get(done, d - 1))
        return F.concat(done, F.array(F.get(F.col("_x"), d).bitwiseXOR(before)))

    def fold(t: Column, q: Column) -> Column:
        last = F.get(F.col("_x"), F.lit(n - 1))
        return F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)

    def interleave(index: Column, step: Column) -> Column:
        bit = F.get(F.col("_x"), step["i"]).bitwiseXOR(F.col("_t")).bitwiseAND(step["q"]) != 0
        return index * 2 + F.when(bit, F.lit(1)).otherwise(F.lit(0))

    frame = frame.withColumn("_x", F.array(*[x.cast("int") for x in levels]))
    if bits > 1:
        frame = frame.withColumn("_x", F.aggregate(pairs(high[:-1]), F.col("_x"), turn))
    frame = frame.withColumn("_x", F.aggregate(dims, F.array().cast("array<int>"), gray))
    powers = F.array(*[F.lit(q) for q in high[:-1]]).cast("array<int>")
    frame = frame.withColumn("_t", F.aggregate(powers, F.lit(0), fold))
    index = F.aggregate(pairs(high), F.lit(0).cast("long"), interleave)
    return frame.withColumn(name, index).drop("_x", "_t")


def hilbert_shards(
    rows: DataFrame,
    shards: int,
    dimensions: tuple[str, ...] = DIMENSIONS,
    key: str = "doc_id",
    text: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """(key, size, text_crc32, curve, shard, slot): runs of the curve whose row counts are at most one apart."""
    utf8 = F.encode("_text", "UTF-8")
    narrow = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *[F.col(d).alias(f"_{i}") for i, d in enumerate(dimensions)])
    narrow = narrow.select(
        F.col("_key").alias(key),
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        *[f"_{i}" for i in range(len(dimensions))],
    )
    narrow = materialise(narrow.withColumn("_at", F.monotonically_increasing_id()), "hilbert-rows")
    for i, d in enumerate(dimensions):
        if isinstance(rows.schema[d].dataType, T.StringType):
            narrow = with_ranks(narrow, f"_{i}")
    places = [F.col(f"_{i}").cast("double").alias(f"_{i}") for i in range(len(dimensions))]
    cuts = quantile_cuts(narrow.select(*places), bits)
    filled = [F.coalesce(place, F.lit(LOWEST)).alias(f"_{i}") for i, place in enumerate(places)]
    narrow = narrow.select(key, "size", "text_crc32", "_at", *filled).select(
        key, "size", "text_crc32", "_at", *[level(F.col(f"_{i}"), cuts[f"_{i}"]).alias(f"_{i}") for i in range(len(dimensions))]
    )
    levels = [F.col(f"_{i}") for i in range(len(dimensions))]
    placed = with_hilbert_index(narrow, levels, bits, "curve").select(key, "size", "text_crc32", "curve", "_at")
    placed = materialise(placed, "hilbert")
    total = placed.count()
    order = [F.col(c).asc_nulls_first() for c in ("curve", "text_crc32", key, "size", "_at")]
    shard = F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    ranked = dense_index(placed, order, "_rank").withColumn("shard", shard)
    return ranked.withColumn("slot", F.col("_rank") - start).drop("_rank", "_at")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows that carry shard and slot as one folder per shard, each in curve order."""
    tasks = rows.select("shard").distinct().count()
    ordered = rows.repartitionByRange(max(tasks, 1), "shard").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
