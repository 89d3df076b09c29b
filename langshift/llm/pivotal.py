"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words, so each of its documents a fractional number of copies.  The whole part is taken;
the fractions are rounded dependently: two documents meet, mass in words moves from one to the other at random and
without bias until one fraction becomes 0 or 1, and the other goes on to meet the next.  The words that a source
takes therefore stay at its target up to one last document, and each document's expected copies are its fraction.

The meetings form a reduction tree.  A hash deals a source's documents to blocks of about BLOCK; a block leaves at
most one document undecided; these meet in blocks of blocks, level by level, until one per source is left, which
chance decides.  Blocks depend on the documents alone, so reruns agree whatever the partitioning, and a source of any
size is shared by many tasks.

Defined results: a null text has size 0; a document of size 0 takes nothing; a null source comes last in code-point
order; repeated rows are documents of their own (they draw different numbers); an empty table, or one without words,
gives targets of 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.operators.ranking import dense_index, group_rank
from langshift.operators.storage import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words, taken together
MOST = 2  # times its size that a source, and a document, may give
BLOCK = 512  # documents that meet in one block
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, documents, target): shares by weight, stopped at `most` times a source's size, the excess reshared.

    Each step finds the sources whose share is too large and shares the rest anew; a step is one small aggregation
    over the table of sources, which stays distributed.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sums = materialise(totals, "mix-sources")
    named = sums.where("source is not null")
    order = dense_index(named, [F.col("source")], "place")
    last = sums.where("source is null").withColumn("place", F.lit(named.count()).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = order.unionByName(last).select("source", "source_size", "documents", weight.alias("weight"))
    table = materialise(table, "mix-weights")
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    top, rate = F.col("source_size") * most, 0.0
    while True:
        stopped = F.col("weight") * rate >= top
        row = table.agg(
            F.sum(F.when(stopped, top)).alias("given"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")
        ).first()
        left, weights_left = share * whole - (row["given"] or 0.0), row["open"] or 0.0
        new = left / weights_left if weights_left > 0 else rate
        if weights_left <= 0 or new <= rate:
            break
        rate = new
    target = F.least(F.col("weight") * rate, top.cast("double")).alias("target")
    return materialise(table.select("source", "source_size", "documents", target), "mix-targets")


def _round_block(level: int) -> Callable[[pa.Table], pa.Table]:
    """Meetings inside one block, long documents first, so that the one left undecided is most likely short."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("order", "ascending")])
        size, part = block["size"].to_numpy().astype(np.float64), block["part"].to_numpy().copy()
        first = block["order"][0].as_py()
        chance = np.random.default_rng([SEED, level, first & (2**63 - 1), len(part)]).random(len(part))
        held = -1
        for i in range(len(part)):
            if not TOLERANCE < part[i] < 1 - TOLERANCE:
                part[i] = round(part[i])
                continue
            if held < 0:
                held = i
                continue
            j, a, b = held, size[held], size[i]
            up = min((1 - part[j]) * a, part[i] * b)  # words that can move from i to j
            down = min(part[j] * a, (1 - part[i]) * b)
            if chance[i] * (up + down) < down:
                part[j], part[i] = part[j] + up / a, part[i] - up / b
            else:
                part[j], part[i] = part[j] - down / a, part[i] + down / b
            open_j = TOLERANCE < part[j] < 1 - TOLERANCE
            open_i = TOLERANCE < part[i] < 1 - TOLERANCE
            for k in (i, j):
                if not TOLERANCE < part[k] < 1 - TOLERANCE:
                    part[k] = round(part[k])
            held = j if open_j else i if open_i else -1
        block = block.set_column(block.column_names.index("part"), "part", pa.array(part))
        return block.append_column("open", pa.array(np.arange(len(part)) == held))

    return run


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add to rows of (id, source, size, documents) an `order`, different for each copy of a row, and the `block` of its meetings."""
    rows = rows.withColumn("order", F.xxhash64(F.lit(SEED), "id", "source", "size"))
    place = F.xxhash64("id", "size", F.lit(SEED))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("order").alias("keys")).first()
    if counts["rows"] > counts["keys"]:
        numbered = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "mix-numbered")
        rows, more = group_rank(numbered, "order", "_at"), F.col("rn") > 1
        place = F.when(more, F.xxhash64("id", "size", F.lit(SEED), "rn")).otherwise(place)
        order = F.when(more, F.xxhash64("order", "rn")).otherwise(F.col("order"))
        rows = rows.withColumn("_place", place).withColumn("order", order).drop("_at", "rn", "n")
    else:
        rows = rows.withColumn("_place", place)
    return rows.withColumn("block", F.pmod("_place", F.ceil(F.col("documents") / block))).drop("_place")


def mix(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of (id, source, size)."""
    stored = materialise(sizes.select("id", "source", "size"), "mix-rows")
    rows = stored.withColumn("source", F.struct("source"))  # a struct is never null, so that nulls join
    targets = source_targets(stored).withColumn("source", F.struct("source"))
    fraction = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = rows.join(targets, "source").withColumn("rate", F.least(fraction, F.lit(float(MOST))))
    whole = F.floor("rate").cast("int")
    placed = placed.withColumn("whole", whole).withColumn("part", F.col("rate") - F.col("whole"))
    spread = max(1, math.ceil(stored.count() / block))
    placed = dealt(placed, block).select(
        "id", "source", "size", "source_size", "target", "whole", "part", "order", "block"
    )
    schema = placed.withColumn("open", F.lit(True)).schema
    level, done = 0, []
    work = placed
    while True:
        met = work.groupBy("source", "block").applyInArrow(_round_block(level), schema)
        met = materialise(met, f"mix-level{level}")
        done.append(met.where("not open"))
        work = met.where("open").drop("open")
        if spread == 1:
            break
        spread, level = math.ceil(spread / block), level + 1
        work = work.withColumn("block", F.pmod("block", F.lit(spread)))
    last = (F.pmod(F.xxhash64("order", F.lit(1)), F.lit(1 << 30)) / (1 << 30)) < F.col("part")
    done.append(work.withColumn("part", F.when(last, F.lit(1.0)).otherwise(F.lit(0.0))).withColumn("open", F.lit(False)))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    copies = (F.col("whole") + F.col("part")).cast("int")
    return result.select("id", F.col("source.source").alias("source"), "size", "source_size", "target", copies.alias("copies"))


def mix_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, copies, taken) for every document."""
    named = documents.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    mixed = mix(named)
    return mixed.select(
        F.col("id").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
