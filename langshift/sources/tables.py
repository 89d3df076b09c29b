"""Sources: accounts, network, messages, feature tables and the trust score table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langshift.config import DEFAULT_TOPICS, feature_table_name, slice_tables
from langshift.sources import schema

FEATURE_COLUMNS = ("id", "group_id", "feat", "value", "group_norm")
TRUST_COLUMNS = ("user_id", "num_of_friends", "wo_retweets", "first_part", "diff_score")


def read_table(spark: SparkSession, location: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """One table from any Spark source.

    `read_table(spark, path)` reads Parquet.  For a relational database pass `fmt="jdbc"` with `url`,
    `dbtable` and, for tables of any size, `partitionColumn`, `lowerBound`, `upperBound` and
    `numPartitions`, so that the read is spread over the executors.  Filters and column selections
    put on the result reach either source.
    """
    reader = spark.read.format(fmt).options(**options)
    return reader.load(location) if location is not None else reader.load()


def read_accounts(spark: SparkSession, location: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Accounts with typed columns; what a study does not use may be missing."""
    return schema.conform(read_table(spark, location, fmt, **options), schema.ACCOUNTS, ("id",))


def read_network(spark: SparkSession, location: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Follow edges with ids as numbers; repeated rows stay."""
    return schema.conform(read_table(spark, location, fmt, **options), schema.NETWORK, tuple(schema.NETWORK))


def read_messages(spark: SparkSession, location: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    return schema.conform(read_table(spark, location, fmt, **options), schema.MESSAGES, ("message_id", "user_id"))


def require_columns(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = sorted(set(names) - set(table.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return table


def tag_slices(*slices: DataFrame) -> DataFrame:
    """Stack the feature tables of slices 0, 1 and 2 under a literal `slice` column."""
    tagged = [
        schema.conform(part, schema.FEATURES, FEATURE_COLUMNS).select(F.lit(number).alias("slice"), *FEATURE_COLUMNS)
        for number, part in enumerate(slices)
    ]
    return reduce(DataFrame.unionByName, tagged)


def read_features(
    spark: SparkSession,
    root: str | None = None,
    tercile: int = 0,
    topics: str = DEFAULT_TOPICS,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    **name_parts,
) -> DataFrame:
    """The three feature tables of a study, from a folder or from a database.

    With a folder each table is a file or folder of its name in `root`.  Without one the name goes into the
    option `dbtable`, as `fmt="jdbc"` expects it, quoted because it holds dollar signs.
    """
    names = [feature_table_name(table, topics, **name_parts) for table in slice_tables(tercile)]
    return tag_slices(*(read_table(spark, **feature_source(root, name, fmt, options or {})) for name in names))


def feature_source(root: str | None, name: str, fmt: str, options: dict[str, str]) -> dict[str, str]:
    """What `read_table` gets for one feature table."""
    if root is not None:
        return {"location": f"{root}/{name}", "fmt": fmt, **options}
    quote = options.get("quote", "`")
    rest = {key: value for key, value in options.items() if key != "quote"}
    return {"fmt": fmt, "dbtable": f"{quote}{name}{quote}", **rest}


def read_trust_scores(spark: SparkSession, location: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """The score table with whatever columns it has; the ones the trust study needs must be there."""
    return schema.conform(read_table(spark, location, fmt, **options), schema.TRUST_SCORES, TRUST_COLUMNS)
