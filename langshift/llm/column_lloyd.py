"""Centroid clustering by Lloyd's method with the dimensions cut into shards, in whole numbers.

Vectors are packed into blocks of rows and column shards.  In a round a task takes a column block and, with the slice
of the centroids that belongs to its shard, computes exact partial squared distances; the partial distances of a block
of rows meet by its number, are added up, and the nearest centroid is taken (ties: the smaller number).  Then each
shard meets the labels of its blocks, adds up its own columns by label and updates its own slice of the centroids with
the floor of sum by count; a centroid without vectors stays.

The column blocks are written once as a table bucketed by shard and block, so that rounds move partial distances and
labels but never the vectors.  Only the centroids, `k` times `dim` numbers, come to the driver and are broadcast.

Defined results: vectors that are null, of another length or hold a null or non-finite component are left out;
components stop at 2 ** 27 either way (an input of 131,072 at scale 1024), so that every distance is a long; sums beyond
a long stop at its end; repeated rows and ids are vectors of their own; a null id counts as an empty one in the starting
order, and equal ids are ordered by their vectors; fewer vectors than `k` give as many centroids; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from langshift.operators.storage import materialise, stage_path

DIM = 64
SCALE = 1024.0
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SHARD_COLUMNS = 16
BLOCK_ROWS = 4096
BUCKET_BYTES = 1 << 27  # of vectors that one bucket of the table should hold at most
LIMIT = 1 << 27
_LONG = 2**63 - 1


def whole_numbers(vector: Column, dim: int = DIM, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are left out."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    limit = F.lit(float(LIMIT))
    ints = F.transform(wide, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x, limit), -limit)).cast("int"))
    return F.when(finite & (F.size(vector) == dim), ints)


def starting_centroids(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors of (id, ints) with the smallest hash of their id, in hash order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("name"), "ints").orderBy("name", "ints").limit(k).collect()
    return np.array([r["ints"] for r in first], np.int64)


def column_blocks(rows: DataFrame, dim: int, width: int = SHARD_COLUMNS, block: int = BLOCK_ROWS) -> DataFrame:
    """(shard, block, ids, data): up to `block` rows by `width` columns as 32-bit numbers; ids in shard 0 only.

    Written as a table bucketed by shard and block.
    """
    spark = rows.sparkSession
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()),
        T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("data", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ints = batch.column(1).flatten().to_numpy().astype(np.int32).reshape(-1, dim)
            for first in range(0, len(ints), block):
                part, ids = ints[first : first + block], batch.column(0).slice(first, block).to_pylist()
                data = [part[:, a : a + width].tobytes() for a in range(0, dim, width)]
                columns = (range(len(data)), [number] * len(data), [ids, *[None] * (len(data) - 1)], data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
                number += 1

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * dim * 4 // BUCKET_BYTES))
    packed = rows.select("id", "ints").mapInArrow(run, schema).repartition(buckets, "shard", "block")
    name = f"langshift_columns_{uuid.uuid4().hex}"
    writer = packed.write.format("parquet").bucketBy(buckets, "shard", "block").sortBy("shard", "block")
    writer.option("path", stage_path(spark, "lloyd-columns")).saveAsTable(name)
    return spark.table(name)


def _partial(centroids: np.ndarray, width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial squared distances of each column block to all centroids, in the narrowest type."""
        for batch in batches:
            shards, blocks, data = (batch.column(c).to_pylist() for c in range(3))
            for shard, block, raw in zip(shards, blocks, data, strict=True):
                own = centroids[:, shard * width : (shard + 1) * width]
                x = np.frombuffer(raw, np.int32).reshape(-1, own.shape[1]).astype(np.int64)
                part = np.stack([((x - c) ** 2).sum(axis=1) for c in own], axis=1)
                narrow = part.astype(np.int32) if part.max(initial=0) < 2**31 else part
                yield pa.RecordBatch.from_pydict({"block": [block], "rows": [len(x)], "part": [narrow.tobytes()]})

    return run


def _nearest(k: int):  # noqa: ANN202
    def run(parts: pa.Table) -> pa.Table:
        """Adds the partial distances of a block of rows and takes the nearest centroid."""
        rows = parts["rows"][0].as_py()
        total = np.zeros((rows, k), np.int64)
        for raw in parts["part"].to_pylist():
            total += np.frombuffer(raw, np.int32 if len(raw) == 4 * rows * k else np.int64).reshape(rows, k)
        label = total.argmin(axis=1)
        far = total[np.arange(rows), label]
        return pa.table({"block": parts["block"][:1], "labels": [label.astype(np.int32).tobytes()], "distances": [far.tobytes()]})

    return run


def assign(columns: DataFrame, centroids: np.ndarray, width: int = SHARD_COLUMNS) -> DataFrame:
    """(block, labels, distances) of every block of rows, as packed numbers; written."""
    parts = columns.select("shard", "block", "data").mapInArrow(_partial(centroids, width), "block long, rows long, part binary")
    met = parts.groupBy("block").applyInArrow(_nearest(len(centroids)), "block long, labels binary, distances binary")
    return materialise(met, "lloyd-labels")


def _column_sums(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by label of the column blocks that a task holds, one row for each shard."""
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            shards, data, labels = (batch.column(c).to_pylist() for c in range(3))
            for shard, raw, packed in zip(shards, data, labels, strict=True):
                label = np.frombuffer(packed, np.int32)
                x = np.frombuffer(raw, np.int32).reshape(len(label), -1).astype(np.int64)
                own = sums.setdefault(shard, np.zeros((k, x.shape[1]), np.int64))
                for c in np.unique(label):
                    own[c] += x[label == c].sum(axis=0)
                counts[shard] = counts.get(shard, 0) + np.bincount(label, minlength=k)
        names = list(sums)
        packed = ([sums[s].tobytes() for s in names], [counts[s].astype(np.int64).tobytes() for s in names])
        columns = (pa.array(names, pa.int32()), *(pa.array(c, pa.binary()) for c in packed))
        yield pa.RecordBatch.from_arrays(list(columns), names=["shard", "sums", "counts"])

    return run


def _updated(centroids: np.ndarray, width: int):  # noqa: ANN202
    def run(sums: pa.Table) -> pa.Table:
        """A shard's new slice of the centroids."""
        shard, k = sums["shard"][0].as_py(), len(centroids)
        own = centroids[:, shard * width : (shard + 1) * width].astype(object)
        total, count = np.zeros_like(own), np.zeros(k, object)
        for raw, n in zip(sums["sums"].to_pylist(), sums["counts"].to_pylist(), strict=True):
            total += np.frombuffer(raw, np.int64).reshape(own.shape)
            count += np.frombuffer(n, np.int64)
        full = count > 0
        own[full] = total[full] // count[full, None]  # whole numbers of any size; // is the floor
        return pa.table({"shard": sums["shard"][:1], "slice": [own.astype(np.int64).tobytes()]})

    return run


def update(columns: DataFrame, labels: DataFrame, centroids: np.ndarray, width: int = SHARD_COLUMNS) -> np.ndarray:
    """The centroids after every shard has updated its own slice."""
    k, dim = centroids.shape
    every = F.explode(F.sequence(F.lit(0), F.lit(-(-dim // width) - 1))).alias("shard")
    met = columns.select("shard", "block", "data").join(labels.select("block", "labels", every), ["shard", "block"])
    sums = met.select("shard", "data", "labels").mapInArrow(_column_sums(k), "shard int, sums binary, counts binary")
    slices = sums.groupBy("shard").applyInArrow(_updated(centroids, width), "shard int, slice binary")
    new = centroids.copy()
    for row in slices.collect():  # k times dim numbers in all
        a = row["shard"] * width
        new[:, a : a + width] = np.frombuffer(row["slice"], np.int64).reshape(k, -1)
    return new


def _members(kind: T.DataType):  # noqa: ANN202
    arrow = to_arrow_schema(T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, far in zip(batch.column(0), *(batch.column(c).to_pylist() for c in (1, 2)), strict=True):
                columns = (ids.values, np.frombuffer(labels, np.int32), np.frombuffer(far, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return run



def cluster(
    rows: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: float = SCALE,
    key: str = "vec_id",
    vector: str = "embedding",
    width: int = SHARD_COLUMNS,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    kept = rows.select(F.col(key).alias("id"), whole_numbers(F.col(vector), dim, scale).alias("ints")).where("ints is not null")
    stored = materialise(kept, "lloyd-rows")
    centroids = starting_centroids(stored, k)
    if not len(centroids):
        name = kind.simpleString()
        schema = f"`{key}` {name}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    columns = column_blocks(stored, dim, width, block)
    labels = assign(columns, centroids, width)
    for _ in range(rounds):
        centroids = update(columns, labels, centroids, width)
        labels = assign(columns, centroids, width)
    named = columns.where("shard = 0").select("block", "ids").join(labels, "block").select("ids", "labels", "distances")
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    members = materialise(named.mapInArrow(_members(kind), schema), "lloyd-members")
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("_sum")).collect()
    whole = sum(int(r["_sum"]) for r in sums)
    own = {r["cluster"]: int(r["_sum"]) for r in sums}
    facts = [(i, min(own.get(i, 0), _LONG), min(whole, _LONG), sha) for i, sha in digest]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = members.join(F.broadcast(facts), "cluster")  # k rows
    return joined.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
