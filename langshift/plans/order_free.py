"""Cosines and topic statistics of a study that do not depend on the order in which rows meet, not in their last bit.

Every sum is an `order_free_sum`.  Its binary places need a bound per topic, and minimum and maximum, which are free of
order, give one.  Scores are multiplied by a power of two so that the bound is 1 for every topic; from there on the
places are constants, the joins are those of the study, and cosines are what they are without the scale.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.operators import features as feature_ops
from langshift.operators import influence as influence_ops
from langshift.operators.order_free import order_free_parts, order_free_sum, order_free_total, unit_scale
from langshift.operators.storage import materialise
from langshift.plans.study import Study

_CELL_BITS, _PRODUCT_BITS = 1, 4  # of differences of scaled scores, and of products of these
_ADDING = influence_ops.Adding(
    lambda value: order_free_parts(value, _CELL_BITS), lambda sums: order_free_total(sums, _CELL_BITS)
)


class OrderFree:
    """`statistics` and `cosines` of a study; scores that are NaN or infinite end the job."""

    def __init__(self, study: Study):
        self.study = study

    @cached_property
    def _ranges(self) -> DataFrame:
        """(feat, n, scale, and rows, min and max of each slice)."""
        names = [f"{name}{number}" for number in feature_ops.SLICES for name in ("rows", "min", "max")]
        sizes = [F.abs(f"{name}{number}") for number in feature_ops.SLICES for name in ("min", "max")]
        ranges = self.study.statistics.select("feat", "n", unit_scale(F.greatest(*sizes)).alias("scale"), *names)
        return materialise(ranges, "ranges")

    @cached_property
    def _range_count(self) -> int:
        return self._ranges.count()

    def _per_topic(self, table: DataFrame, aggregate) -> DataFrame:
        """The table of topics with one more column per slice: `aggregate` of the cells' scaled scores."""
        for cells, slices in ((self.study.core_cells, (0, 1)), (self.study.reference_cells, (2,))):
            rows = self.study.attach_small(cells, table.drop("n"), "feat", "group_id", self._range_count)
            sums = rows.groupBy("feat").agg(*(aggregate(number, F.col(f"s{number}") * F.col("scale")) for number in slices))
            table = table.join(sums, "feat", "left")
        return table

    @cached_property
    def _sums(self) -> DataFrame:
        """The ranges with the sums of the scaled scores of each slice."""

        def total(number: int, score: Column) -> Column:
            return order_free_sum(score).alias(f"scaled{number}")

        return materialise(self._per_topic(self._ranges, total), "order-free-sums")

    @cached_property
    def statistics(self) -> DataFrame:
        """As `Study.statistics`: the squares are taken about the mean of the rows, which a pass before has found."""

        def spread(number: int, score: Column) -> Column:
            apart = score - F.col(f"scaled{number}") / F.nullif(F.col(f"rows{number}"), F.lit(0))
            return order_free_sum(apart * apart, 2).alias(f"squares{number}")

        scale, wide = F.col("scale"), self._per_topic(self._sums, spread)
        for number in feature_ops.SLICES:
            rows = F.nullif(F.col(f"rows{number}"), F.lit(0))
            wide = wide.withColumns(
                {
                    f"sum{number}": F.col(f"scaled{number}") / scale,
                    f"spread{number}": F.col(f"squares{number}") / rows / scale / scale,
                }
            )
        return feature_ops.zero_filled(wide)

    @cached_property
    def topics(self) -> DataFrame:
        """(feat, topic, scale, base_avg, divisor, cells) of the varying topics, base_avg in scaled scores."""
        varying = feature_ops.varying_topics(self._sums)
        mean = F.coalesce("scaled2", F.lit(0.0)) / F.col("n")
        number = F.monotonically_increasing_id().alias("topic")
        columns = ("feat", number, "scale", mean.alias("base_avg"), F.lit(1.0).alias("divisor"), F.col("rows2").alias("cells"))
        return materialise(varying.select(*columns), "order-free-topics")

    @cached_property
    def _topic_count(self) -> int:
        return self.topics.count()

    def _scaled(self, cells: DataFrame, *names: str) -> DataFrame:
        """Cells of varying topics, scaled, with the topic's number in place of its name."""
        table = self.topics.select("feat", "topic", "scale")
        rows = self.study.attach_small(cells, table, "feat", "group_id", self._topic_count)
        return rows.withColumns({name: F.col(name) * F.col("scale") for name in names}).drop("feat", "scale")

    @cached_property
    def _support(self) -> DataFrame:
        study = self.study
        parts = study.pack(self._scaled(study.reference_cells, "s2"), self.topics, self._topic_count)
        shares = ["friend_share"] + (["base_share"] if study.variant.baseline == "random" else [])
        neighbours = influence_ops.neighbour_sums(study.links, *parts, shares, study.hot_friends(parts[1]), _ADDING)
        own = self._scaled(study.own_cells, "s0", "s1")
        return influence_ops.support_rows(own, neighbours, study.variant.baseline, study.scores is not None, _ADDING)

    @cached_property
    def cosines(self) -> DataFrame:
        """As `Study.cosines`."""
        table = self.topics.select("topic", "base_avg")
        support = self.study.attach_small(self._support, table, "topic", "id", self._topic_count)
        topics = self.topics.drop("scale", "cells")
        sums = influence_ops.moments(support, topics, self.study.user_flags, lambda value: order_free_sum(value, _PRODUCT_BITS))
        return influence_ops.cosines(sums)
