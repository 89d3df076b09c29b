"""Sinks.  Each writes a folder of part files from the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langshift.functions.columns import float_text


def above_threshold(results: DataFrame, value: str, threshold: float = 0.0) -> DataFrame:
    """Rows whose value lies strictly further from zero than the threshold; NULL and NaN never do."""
    return results.where((F.abs(F.col(value)) > threshold) & ~F.isnan(value))


def score_lines(results: DataFrame, key: str, value: str, threshold: float = 0.0) -> DataFrame:
    """`key<TAB>,<TAB>value` for the rows above the threshold."""
    kept = above_threshold(results, value, threshold)
    return kept.select(F.concat_ws("\t,\t", F.col(key), float_text(F.col(value))).alias("line"))


def vector_lines(results: DataFrame, key: str, values: list[str]) -> DataFrame:
    """`key<TAB>:<TAB>v1<TAB>v2<TAB>...` with a tab after the last value; never thresholded."""
    numbers = [F.concat(float_text(F.col(name)), F.lit("\t")) for name in values]
    return results.select(F.concat(F.col(key), F.lit("\t:\t"), *numbers).alias("line"))


def list_lines(rows: DataFrame, column: str) -> DataFrame:
    """One element per line."""
    return rows.select(F.col(column).cast("string").alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    lines.write.mode(mode).text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Add a derived table's rows to a stored table."""
    rows.write.mode("append").parquet(path)


def append_in_parts(rows: DataFrame, column: str, parts: int, path: str) -> None:
    """The same in several appends that every row is in one of, whatever the number in `column`; a null is in the first."""
    part = F.coalesce(F.pmod(F.col(column), F.lit(parts)), F.lit(0))
    for number in range(parts):
        append_rows(rows.where(part == number), path)


def table_like(table: DataFrame, add: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """An empty table with the schema of another, with columns added (name -> type) and dropped."""
    fields = [field for field in table.schema.fields if field.name not in drop]
    for name, type_name in (add or {}).items():
        fields.append(T.StructField(name, T.DataType.fromDDL(type_name), True))
    return table.sparkSession.createDataFrame([], T.StructType(fields))
