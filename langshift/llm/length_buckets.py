"""Packing into length buckets whose boundaries minimise padding over the whole corpus.

One aggregation makes the exact global histogram: distinct lengths sum to at most the words of the corpus, so there are
fewer than the root of twice that number.  Dynamic programming over all of them finds the best boundaries, in time
linear in the distinct lengths for each bucket.  Inside a bucket documents stand in hash order
and are cut into batches: as many documents as fit the token budget when all are padded to the bucket's boundary.
Positions come from one range sort over all buckets, so a bucket of any size is shared by many tasks.

Defined results: a null or blank text has length 0 and belongs to the first bucket; a document longer than the budget
is a batch of its own, whole; repeated rows are documents of their own, sorted by many tasks, since a row number comes
last in the order; with fewer distinct lengths than buckets each
length has its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.llm.pivotal import word_count
from langshift.operators.ranking import dense_index
from langshift.operators.storage import materialise

BUCKETS = 16
TOKEN_BUDGET = 32_768
SEED = 5


def best_boundaries(longest: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Largest lengths of at most `buckets` buckets with the least total of rows times boundary.

    longest are distinct lengths, ascending, and rows (none 0) their counts.  cost[j] is the least total of the
    first j lengths; each round allows one more bucket, which covers the lengths from some i on.  As a
    function of the boundary, what i gives is the line cost[i] + boundary * (rows before j - rows before i), so
    the best i is read off the lower hull of these lines, in whole numbers and in time linear in the lengths.
    """
    lengths, n = [int(x) for x in longest], len(longest)
    before = [0, *np.cumsum(rows).tolist()]
    cost: list[int | None] = [0, *[None] * n]
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = list(cost), array("q", [-1]) * (n + 1)
        hull: list[tuple[int, int, int]] = []  # rows before i, cost[i], i
        head = 0
        for j in range(1, n + 1):
            c = cost[j - 1]
            if c is not None:
                p = before[j - 1]
                while len(hull) > 1:
                    (p1, c1, _), (p2, c2, _) = hull[-2:]
                    if (c - c1) * (p2 - p1) > (c2 - c1) * (p - p1):
                        break
                    hull.pop()
                hull.append((p, c, j - 1))
                head = min(head, len(hull) - 1)
            boundary = lengths[j - 1]
            while head + 1 < len(hull) and hull[head + 1][1] - hull[head + 1][0] * boundary < hull[head][1] - hull[head][0] * boundary:
                head += 1
            p, c, i = hull[head]
            total = c + boundary * (before[j] - p)
            if new[j] is None or total < new[j]:
                new[j], cut[j] = total, i
        cuts.append(cut)
        cost = new
    chosen, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            chosen.append(lengths[j - 1])
            j = cut[j]
    return chosen[::-1]


@dataclass(frozen=True)
class Buckets:
    """Boundaries, documents before each bucket, documents per batch and batches before each bucket."""

    boundary: list[int]
    start: list[int]
    capacity: list[int]
    batch_start: list[int]


def plan_buckets(lengths: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> Buckets:
    """Boundaries over all rows of a table with the column n_tokens; only the histogram comes to the driver."""
    histogram = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows"))
    found = histogram.toArrow().sort_by("n_tokens")
    longest, rows = (found[c].to_numpy().astype(np.int64) for c in ("n_tokens", "rows"))
    boundary = best_boundaries(longest, rows, buckets)
    held = [int(rows[(longest <= b) & (longest > a)].sum()) for a, b in zip([-1, *boundary], boundary, strict=False)]
    capacity = [max(1, budget // max(1, b)) for b in boundary]
    batches = [-(-h // c) for h, c in zip(held, capacity, strict=True)]
    return Buckets(boundary, [sum(held[:k]) for k in range(len(held))], capacity, [sum(batches[:k]) for k in range(len(held))])


def pack(
    documents: DataFrame,
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, n_tokens, bucket, padded, batch, slot): padded is the bucket's boundary, batch is numbered over all."""
    lengths = documents.select(F.col(key).alias("id"), word_count(F.col(text)).alias("n_tokens"))
    lengths = lengths.withColumn("place", F.xxhash64(F.lit(SEED), "id", "n_tokens")).withColumn("at", F.monotonically_increasing_id())
    stored = materialise(lengths, "pack-lengths")
    plan = plan_buckets(stored, buckets, budget)

    def of_bucket(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>"), F.col("bucket"))

    bucket = F.lit(0)
    for boundary in plan.boundary[:-1]:
        bucket = bucket + F.when(F.col("n_tokens") > boundary, 1).otherwise(0)
    order = [F.col(c).asc_nulls_first() for c in ("bucket", "place", "id", "at")]
    ranked = dense_index(stored.withColumn("bucket", bucket), order, "rank")
    inside = ranked.withColumn("rank", F.col("rank") - of_bucket(plan.start)).withColumn("capacity", of_bucket(plan.capacity))
    batch = of_bucket(plan.batch_start) + F.floor(F.col("rank") / F.col("capacity")).cast("long")
    return inside.select(
        F.col("id").alias(key), "n_tokens", "bucket", of_bucket(plan.boundary).alias("padded"),
        batch.alias("batch"), F.pmod("rank", "capacity").cast("int").alias("slot"),
    )
