"""The study's input tables derived from the order tables used for tests and benchmarks.

Orders are messages of the customer, a customer with order lines for part k follows account k, and the
brands of a user's parts in a period are the user's topics.  Every step is linear in the order lines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langshift.config import PRESETS, Variant
from langshift.operators.prep import message_parts
from langshift.operators.storage import materialise
from langshift.sources.tables import read_table

COPIED_IDS = 10
COPY_COUNTER = 1_000_000
UNCOUNTED = 17  # one account in so many has no recorded friends count
LONELY = 13  # one scored customer in so many has a single friend
LATE_TOPIC, EARLY_TOPIC = "Brand#25", "Brand#11"  # never in slice 0, only in slice 0

# The published thresholds are made for a crawl; these suit about ten orders and forty lines per customer.
_POPULATION = {"min_statuses": 5, "min_degree": 20}
VARIANTS: dict[str, Variant] = {
    "minmax_population": PRESETS["minmax_population"].but(**_POPULATION),
    "ols_population": PRESETS["ols_population"].but(**_POPULATION),
    "raw_population": PRESETS["raw_population"].but(**_POPULATION),
    "capped_random": PRESETS["capped_random"].but(friend_cap=10),
    "trust": PRESETS["trust"],
}


class Fixture:
    """All input tables over one folder of order tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("message_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("o_orderpriority") == "5-LOW").alias("is_rt"),
        )

    @cached_property
    def messages_nrt(self) -> DataFrame:
        return self.messages.where(~F.col("is_rt"))

    @cached_property
    def network(self) -> DataFrame:
        """A multigraph: buying two lines of part k follows account k twice; some k have no account."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("dest_id"))
        buyers = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
        return lines.join(buyers.hint("shuffle_hash"), "o_orderkey").select("source_id", "dest_id").where("source_id <> dest_id")

    @cached_property
    def accounts(self) -> DataFrame:
        """Customers with their activity; ids up to COPIED_IDS occur twice, with a later counter."""
        statuses = self.messages.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("statuses_count"))
        followed = self.network.groupBy(F.col("source_id").alias("id")).agg(
            F.count(F.lit(1)).alias("recorded_friends_count")
        )
        counters = F.array(F.col("id"), F.when(F.col("id") <= COPIED_IDS, F.col("id") + COPY_COUNTER))
        customers = self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), (F.col("c_custkey") % 4).cast("int").alias("level")
        )
        return (
            customers.join(statuses, "id", "left")
            .join(followed, "id", "left")
            .select(
                "id",
                "username",
                "level",
                F.coalesce("statuses_count", F.lit(0)).alias("statuses_count"),
                F.when(F.col("id") % UNCOUNTED != 0, F.coalesce("recorded_friends_count", F.lit(0))).alias("recorded_friends_count"),
                F.lit(None).cast("long").alias("followers_count"),
                F.coalesce("recorded_friends_count", F.lit(0)).alias("friends_count"),
                F.lit(None).cast("long").alias("favourites_count"),
                F.lit(None).cast("timestamp_ntz").alias("created_at"),
                F.lit(None).cast("long").alias("last_message_id"),
                F.explode(F.array_compact(counters)).alias("counter"),
            )
        )

    @cached_property
    def parts(self) -> DataFrame:
        """Non-retweets with the `half` (1, 2) and `third` (1, 2, 3) of their user's messages."""
        return message_parts(self.messages_nrt, half=2, third=3)

    def features(self, tercile: int = 0) -> DataFrame:
        """Topic scores: slices 0 and 1 are the halves, slice 2 the whole period or one tercile.

        The three counts of a user and brand come from one aggregation and are unpacked afterwards.
        """
        parted = self.parts.select("message_id", F.col("user_id").alias("group_id"), "half", "third")
        in_reference = F.col("third") == tercile if tercile in (1, 2) else F.lit(True)
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("p_partkey"))
        brands = self.table("part").select("p_partkey", F.col("p_brand").alias("feat"))
        in_slice = (F.col("half") == 1, F.col("half") == 2, in_reference)
        counted = (
            lines.join(parted.hint("shuffle_hash"), "message_id")
            .join(brands.hint("shuffle_hash"), "p_partkey")
            .groupBy("group_id", "feat")
            .agg(*(F.count_if(condition).cast("double").alias(f"value{number}") for number, condition in enumerate(in_slice)))
        )
        by_user = Window.partitionBy("group_id")
        cells = [
            F.struct(
                F.lit(number).alias("slice"),
                F.col(f"value{number}").alias("value"),
                (F.col(f"value{number}") / F.col(f"total{number}")).alias("group_norm"),
            )
            for number in range(3)
        ]
        totals = {f"total{number}": F.nullif(F.sum(f"value{number}").over(by_user), F.lit(0.0)) for number in range(3)}
        brand = F.substring_index("feat", "#", -1).cast("long")
        return (
            counted.withColumns(totals)
            .select("group_id", "feat", F.explode(F.array(*cells)).alias("cell"))
            .where("cell.value > 0")
            .where(~((F.col("feat") == LATE_TOPIC) & (F.col("cell.slice") == 0)))
            .where(~((F.col("feat") == EARLY_TOPIC) & (F.col("cell.slice") > 0)))
            .select(
                "cell.slice",
                ((F.col("group_id") * 3 + F.col("cell.slice")) * 1000 + brand).alias("id"),
                "group_id",
                "feat",
                "cell.value",
                "cell.group_norm",
            )
        )

    @cached_property
    def trust_scores(self) -> DataFrame:
        """Mean order value per customer: over all non-retweets, over the first half, and the change.

        Values are added up in whole cents, so the means do not depend on the order of the rows.
        """
        cents = F.round(F.col("o_totalprice") * 100).cast("long")
        price = self.table("orders").select(F.col("o_orderkey").alias("message_id"), cents.alias("cents"))

        def mean(name: str, *halves: int):
            wanted = F.when(F.col("half").isin(*halves), F.col("cents"))
            return (F.try_divide(F.sum(wanted), F.count(wanted)) / 100).alias(name)

        means = (
            self.parts.join(price, "message_id")
            .groupBy("user_id")
            .agg(mean("wo_retweets", 1, 2), mean("first_part", 1), mean("second_part", 2))
        )
        followed = self.network.groupBy(F.col("source_id").alias("user_id")).agg(F.count(F.lit(1)).alias("num_of_friends"))
        customers = self.table("customer").select(F.col("c_custkey").alias("user_id"))
        return (
            customers.join(means, "user_id", "left")
            .join(followed, "user_id", "left")
            .select(
                "user_id",
                F.when(F.col("user_id") % LONELY == 0, F.lit(1)).otherwise(F.coalesce("num_of_friends", F.lit(0))).alias("num_of_friends"),
                "wo_retweets",
                "first_part",
                (F.col("second_part") - F.col("first_part")).alias("diff_score"),
            )
        )


class StoredFixture(Fixture):
    """The same with the tables that studies read written out once, the way a study finds its inputs."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self._features: dict[int, DataFrame] = {}

    @cached_property
    def network(self) -> DataFrame:
        return materialise(super().network, "network")

    @cached_property
    def accounts(self) -> DataFrame:
        return materialise(super().accounts, "accounts")

    @cached_property
    def trust_scores(self) -> DataFrame:
        return materialise(super().trust_scores, "scores")

    def features(self, tercile: int = 0) -> DataFrame:
        if tercile not in self._features:
            self._features[tercile] = materialise(super().features(tercile), "features")
        return self._features[tercile]
