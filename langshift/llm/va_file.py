"""Exact top-k inner products through a vector-approximation file.

Integer vectors that are equal form one class.  Each class is approximated by one byte per component: the cell that
holds it, one number wide near zero and an eighth to a quarter of its value further out.  Queries meet the
approximations in blocks: from the cells follow a lower and an upper bound of every score.  A first scan finds the k-th
largest lower bound of each query over all blocks, a second returns the candidates whose upper bound reaches it.  Approximations
are dealt out to tasks and blocks of queries copied to all of them, a bounded number of bytes at a time: a larger set of queries
takes several pairs of scans, and nothing is copied once per block of the other side.  Exact vectors are then read in bound order: first
those of the k largest upper bounds, which fixes a k-th exact score, and after them only those whose upper bound still
reaches it.  Nothing else can be among the first k, so the result is exact.

Copies of a vector cannot flood a query: a class keeps its k + 1 smallest ids, gathered by a tree of bounded groups.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor are they
queries; vectors of different length do not meet; a null id takes no part; repeated ids are rows of their own, and a
query row excludes one row with its id, itself; ties go to the smaller id; components and scores beyond the range of a
long stop at its ends, though larger products still go first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langshift.operators.ranking import running_total
from langshift.operators.storage import materialise

SCALE = 64.0
QUERY_ROWS = 1024  # of a block of queries
CLASS_ROWS = 8192  # of a block of approximations
CHUNK = 2048  # approximations compared at once
QUERY_BYTES = 16 << 20  # of the blocks of queries, with their lower bounds, that are copied to every task at a time
LANES = 64  # tasks whose lower bounds one group brings together first
GROUP = 1024  # ids or id lists that one group of the gathering tree merges
_EXACT = float(1 << 53)


def quantised(embedding: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    limit = float(2**63 - 1024)
    cells = F.transform(wide, lambda x: F.least(F.greatest(F.floor(F.lit(scale) * x), F.lit(-limit)), F.lit(limit)).cast("long"))
    return F.when(finite & (F.size(embedding) > 0), cells)


def encode(x: np.ndarray) -> np.ndarray:
    """The cell of each integer as a signed byte: magnitudes below 8 alone, then four cells per doubling."""
    size = np.abs(x.astype(np.float64))
    power = np.floor(np.log2(np.maximum(size, 8))).astype(np.int64)
    step = np.minimum((size / np.exp2(power - 2.0)).astype(np.int64) - 4, 3)
    code = np.where(size < 8, size.astype(np.int64), 8 + (power - 3) * 4 + step)
    return (np.sign(x) * np.minimum(code, 127)).astype(np.int8)


def cell_edges() -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer of each cell, at code + 127; cells 127 and -127 are open to the ends of a long."""
    code = np.arange(128)
    power, step = 3 + (code - 8) // 4, (code - 8) % 4
    low = np.where(code < 8, code, (4.0 + step) * np.exp2(power - 2.0))
    high = np.where(code < 8, code, low + np.exp2(power - 2.0) - 1)
    high[127] = 2.0**63
    return np.concatenate((-high[:0:-1], low)), np.concatenate((-low[:0:-1], high))


def gather_classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class, dim, ints, ids, asked): one row per distinct vector with its `keep` smallest ids.

    Ids are merged in a tree: groups of about GROUP rows of a vector first, then of GROUP lists, and so on.
    """
    spread = max(1, math.ceil(rows.count() / GROUP))
    salt = F.pmod(F.xxhash64("row"), F.lit(spread))
    level = rows.select("ints", salt.alias("salt"), F.array("id").alias("ids"), "asked")
    while True:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep)
        level = level.groupBy("ints", "salt").agg(merged.alias("ids"), F.max("asked").alias("asked"))
        if spread == 1:
            break
        spread = math.ceil(spread / GROUP)
        level = level.withColumn("salt", F.pmod("salt", F.lit(spread)))
    numbered = level.select(F.monotonically_increasing_id().alias("class"), F.size("ints").alias("dim"), "ints", "ids", "asked")
    return materialise(numbered, "va-classes")


def _pack(classes: DataFrame, rows: int, approximate: bool) -> DataFrame:
    """Blocks of `rows` classes of one length (fewer where a task ends): their numbers and vectors or approximations, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, full: bool) -> Iterator[pa.RecordBatch]:
            names, values = (np.concatenate(part) for part in zip(*held.pop(dim), strict=True))
            end = len(names) // rows * rows if full else len(names)
            for first in range(0, end, rows):
                piece = slice(first, min(first + rows, end))
                data = {"dim": [dim], "names": [names[piece].tobytes()], "data": [values[piece].tobytes()]}
                yield pa.RecordBatch.from_pydict(data, schema=out)
            if end < len(names):
                held[dim] = [(names[end:], values[end:])]

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                ints = part.column("ints").flatten().to_numpy().reshape(-1, dim)
                held.setdefault(dim, []).append((part.column("class").to_numpy(), encode(ints) if approximate else ints))
                if sum(len(names) for names, _ in held[dim]) >= rows:
                    yield from block(dim, full=True)
        for dim in list(held):
            yield from block(dim, full=False)

    out = pa.schema([("dim", pa.int32()), ("names", pa.binary()), ("data", pa.binary())])
    return classes.select("class", "dim", "ints").mapInArrow(run, "dim int, names binary, data binary")


def _bounds(asks: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, in doubles, widened where these are not exact."""
    middle, half = (low + high) / 2, (high - low) / 2
    centre, swing = asks @ middle.T, np.abs(asks) @ half.T
    largest = np.abs(asks).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * 2 * asks.shape[1]
    if largest >= _EXACT:
        swing += (np.abs(asks) @ (np.abs(middle) + half).T) * 1e-12
    return centre - swing, centre + swing


def _chunks(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, lower bounds, upper bounds) of a block of approximations for a block of queries, chunk by chunk."""
    low_edge, high_edge = cell_edges()
    asks = np.frombuffer(row["q_data"], np.int64).reshape(len(row["q_names"]) // 8, -1).astype(np.float64)
    codes = np.frombuffer(row["data"], np.int8).reshape(len(row["names"]) // 8, -1)
    for first in range(0, len(codes), CHUNK):
        place = codes[first : first + CHUNK].astype(np.int64) + 127
        yield first, *_bounds(asks, low_edge[place], high_edge[place])


def _largest(values: np.ndarray, keep: int) -> np.ndarray:
    """The `keep` largest of each row, in any order."""
    return np.partition(values, values.shape[1] - keep, axis=1)[:, values.shape[1] - keep :] if values.shape[1] > keep else values


def _lower_bounds(keep: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The `keep` largest lower bounds of each query over the blocks of approximations of a task."""
        held: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            for row in batch.to_pylist():
                part, best = row["task"] // LANES, held.get(row["q_block"])
                if best is None:
                    best = np.full((len(row["q_names"]) // 8, keep), -np.inf)
                for _, low, _ in _chunks(row):
                    best = _largest(np.concatenate((best, low), axis=1), keep)
                held[row["q_block"]] = best
        for q_block, best in held.items():
            yield pa.RecordBatch.from_pydict({"q_block": [q_block], "part": [part], "best": [best.tobytes()]}, schema=out)

    out = pa.schema([("q_block", pa.int64()), ("part", pa.int64()), ("best", pa.binary())])
    return run


def _merge_bounds(keep: int):  # noqa: ANN202
    def run(parts: pa.Table) -> pa.Table:
        best = [np.frombuffer(raw, np.float64).reshape(-1, keep) for raw in parts["best"].to_pylist()]
        merged = _largest(np.concatenate(best, axis=1), keep)
        return pa.table({"q_block": parts["q_block"][:1], "best": [merged.tobytes()]})

    return run


def _reaching(keep: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of each joined pair of blocks whose upper bound reaches the query's floor."""
        for batch in batches:
            for row in batch.to_pylist():
                q_names, c_names = np.frombuffer(row["q_names"], np.int64), np.frombuffer(row["names"], np.int64)
                floor = np.frombuffer(row["best"], np.float64).reshape(-1, keep).min(axis=1)
                for first, _, high in _chunks(row):
                    x, y = np.nonzero(high >= floor[:, None])
                    columns = (q_names[x], c_names[first + y], high[x, y])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "class", "high"])

    return run


def _query_parts(queries: DataFrame, keep: int) -> list[tuple[int, int]]:
    """First and last number of the blocks of queries that are copied together: runs of about QUERY_BYTES, their lower bounds included."""
    size = F.length("q_data") + F.length("q_names") * (keep + 1)
    before = running_total(queries.select("q_block", size.cast("long").alias("bytes")), [F.col("q_block")], "bytes", "before")
    runs = before.groupBy(F.floor(F.col("before") / QUERY_BYTES).alias("run")).agg(F.min("q_block"), F.max("q_block"))
    return [(first, last) for _, first, last in runs.orderBy("run").collect()]


def candidates(classes: DataFrame, keep: int) -> DataFrame:
    """(query, class, high) that can be among the first `keep` of the query, from the approximations alone.

    A first scan brings each query's `keep` largest lower bounds together, in two steps of bounded groups; the least of
    them is a floor that holds for the whole table.  The second scan returns only what reaches it.
    """
    queries = _pack(classes.where("asked"), QUERY_ROWS, approximate=False)
    queries = queries.select("dim", F.col("names").alias("q_names"), F.col("data").alias("q_data"))
    queries = materialise(queries.withColumn("q_block", F.monotonically_increasing_id()), "va-queries")
    blocks = materialise(_pack(classes, CLASS_ROWS, approximate=True).withColumn("_at", F.monotonically_increasing_id()), "va-approximations")
    tasks = min(blocks.count(), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks.repartitionByRange(max(1, tasks), "_at").drop("_at")

    def pairs(asking: DataFrame) -> DataFrame:
        return blocks.join(F.broadcast(asking), "dim").drop("dim")

    reached = []
    for first, last in _query_parts(queries, keep) or [(0, 0)]:
        asking = queries.where(F.col("q_block").between(first, last))
        found = pairs(asking).withColumn("task", F.spark_partition_id())
        found = found.mapInArrow(_lower_bounds(keep), "q_block long, part long, best binary")
        for group in (["q_block", "part"], ["q_block"]):
            found = found.groupBy(*group).applyInArrow(_merge_bounds(keep), "q_block long, best binary")
        asking = asking.join(materialise(found, "va-floors"), "q_block")
        reached.append(materialise(pairs(asking).mapInArrow(_reaching(keep), "query long, class long, high double"), "va-reached"))
    return reduce(DataFrame.unionByName, reached)


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the exact score, in whole numbers, to (query, class)."""
    asks = classes.where("asked").select(F.col("class").alias("query"), F.col("ints").alias("_asks"))
    both = pairs.join(classes.select("class", "ints"), "class").join(asks, "query")
    product = F.zip_with("ints", "_asks", lambda a, b: F.try_multiply(a, b))
    score = F.aggregate(product, F.lit(0).cast("long"), lambda s, x: F.try_add(s, x))
    wide = F.zip_with("ints", "_asks", lambda a, b: a.cast("double") * b)
    rough = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)
    digits = F.zip_with("ints", "_asks", lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)"))
    whole = F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), lambda s, x: F.try_add(s, x).cast("decimal(38,0)"))
    least, most = F.lit(-(2**63)), F.lit(2**63 - 1)
    beyond = F.when(rough < 0, least).otherwise(most)
    slow = F.when(whole.between(least, most), whole.cast("long")).otherwise(beyond)  # where a product or sum overflows
    return both.select("query", "class", F.coalesce(score, slow).alias("score"))


def nearest_classes(classes: DataFrame, keep: int) -> DataFrame:
    """(query, class, score): all classes whose score reaches the query's `keep`-th best."""
    found = candidates(classes, keep)
    by_high = Window.partitionBy("query").orderBy(F.col("high").desc(), "class")
    ordered = materialise(found.withColumn("place", F.row_number().over(by_high)), "va-ordered")
    first = materialise(_exact(ordered.where(F.col("place") <= keep), classes), "va-first")
    certain = first.groupBy("query").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    rest = ordered.where(F.col("place") > keep).join(certain, "query").where("high >= kth").select("query", "class")
    scored = first.unionByName(_exact(rest, classes))
    place = F.rank().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    return scored.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def top_k(rows: DataFrame, asks: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row for which `asks` holds."""
    usable = rows.select(F.col(key).alias("id"), quantised(F.col(vector), scale).alias("ints"), asks.alias("asked"))
    usable = usable.where("ints is not null and id is not null").withColumn("asked", F.coalesce("asked", F.lit(False)))
    stored = materialise(usable.withColumn("row", F.monotonically_increasing_id()), "va-rows")
    keep = k + 1  # one more, as the query itself is left out afterwards
    classes = gather_classes(stored, keep)
    best = materialise(nearest_classes(classes, keep), "va-best")
    names = classes.select("class", "ids")
    members = best.join(names, "class").select("query", "class", "score", F.explode("ids").alias("id"))
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    listed = members.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= keep)
    entry = F.struct("place", "class", "id", "score")
    lists = materialise(listed.groupBy("query").agg(F.sort_array(F.collect_list(entry)).alias("list")), "va-lists")
    own = classes.where("asked").select("ints", F.col("class").alias("query")).join(lists, "query")
    asking = stored.where("asked").select(F.col("id").alias("query_id"), "ints").join(own, "ints")
    itself = F.filter("list", lambda e: (e["class"] == F.col("query")) & (e["id"] == F.col("query_id")))
    out = F.coalesce(F.get(itself, F.lit(0))["place"], F.lit(keep + 1))
    others = F.slice(F.filter("list", lambda e: e["place"] != out), 1, k)
    ranked = asking.select("query_id", F.posexplode(others).alias("rank", "e"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), "e.score")
