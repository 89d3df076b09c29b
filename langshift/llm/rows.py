"""Row numbers that decisions about rows travel with, without the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langshift.operators.storage import materialise


def free_name(rows: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from all columns."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(rows: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows with a column that tells them apart, and its name.

    That is the key itself if it is never null and never repeats, which one pass over the key column
    shows; else the rows are written once with a number.
    """
    name = free_name(rows, "_row")
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).first()
    if counts["rows"] == counts["keys"]:
        return rows.withColumn(name, F.col(key)), name
    return materialise(rows.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
