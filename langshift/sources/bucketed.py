"""Edge tables stored in buckets of one end, for joins and counts by that end without moving the edges.

A bucketed table is laid out once: all edges of an account lie in one bucket, sorted.  A later join, semi join or count
by that end reads buckets as they are, and only the other side of a join is shuffled to them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from langshift.operators.storage import stage_path


def bucketed(rows: DataFrame, column: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """The rows as a table with buckets by `column`; by default as many as shuffles have partitions, in the stage folder.

    Fewer buckets than that may be dealt anew by a join.  An empty table is one, too; a null column has a bucket.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"langshift_by_{column}_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).sortBy(column)
    writer.option("path", path or stage_path(spark, f"by-{column}")).saveAsTable(name)
    return spark.table(name)
