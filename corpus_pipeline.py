"""A corpus from raw documents to packed batches: toxicity, near duplicates, source mix, packing.

Stages take whole documents and return documents with the same columns; the last returns places in batches.  All
decisions are made on narrow tables of row numbers.  Repeated rows and repeated or null doc_ids are rows of their own;
nulls, empty texts and empty tables are treated as the operators say; columns beyond the known ones pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langshift.llm import ftrl, length_buckets, near_copies, pivotal
from langshift.llm.rows import free_name, keyed
from langshift.operators.storage import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; learned from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~ftrl.held_out(F.col("doc_id")))
    return ftrl.below(docs, ftrl.train(docs, labels, "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that links by five-word Jaccard of 0.8 or more.

    Groups of the SimHash Gray-order index are settled first; every other pair is found by exact comparison.
    """
    rows, row = keyed(docs)
    kept = near_copies.near_copies(rows, row).where(F.col(row) == F.col("component_id")).select(row)
    return rows.join(materialise(kept, "deduplicated"), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, row = keyed(docs)
    mixed, copies = free_name(rows, "_mixed"), free_name(rows, "_copies")
    taken = pivotal.mix_documents(rows, key=row).where("copies > 0").select(F.col(row).alias(mixed), F.col("copies").alias(copies))
    joined = rows.join(materialise(taken, "mixed"), F.col(row) == F.col(mixed))
    again = joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return again.select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document, copies included, in the batches of its length bucket."""
    return length_buckets.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Training a classifier and random rounding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written as Parquet and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
