"""A study from its inputs to its scores.

Every property is a DataFrame; asking for one builds only what it needs.  Four user sets are kept apart:
*everybody* (N, the divisor of all statistics), *core*, *loaded* (core and the users their edges lead
to; only these have reference scores) and *kept* (core with enough friends; only these are compared).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.config import PRESETS, Variant
from langshift.operators import features as feature_ops
from langshift.operators import influence as influence_ops
from langshift.operators import network as network_ops
from langshift.operators import trust as trust_ops
from langshift.operators import users as user_ops
from langshift.operators.sampling import draw_people
from langshift.operators.skew import BROADCAST_ROWS, MIN_HOT_ROWS, attach_small, heavy_pairs, looked_up
from langshift.operators.storage import materialise, together

Input = DataFrame | Callable[[], DataFrame]


def _study_users(accounts: Callable[[], DataFrame], variant: Variant) -> DataFrame:
    return user_ops.study_users(accounts(), variant)


class Study:
    """One variant applied to users (id, is_core), network, features and, for trust, scores.

    The tables that several steps read (users, edges, kept, the cells and the topics) are stage tables:
    asking for them, or for anything built on them, runs the jobs that write them.  Network and features may be
    given as functions, which are called when the table is first needed; so may users.  Scores by user and topic need features and
    edges, so the jobs that write these two are run side by side.
    """

    def __init__(
        self,
        users: Input,
        network: Input,
        features: Input,
        variant: Variant,
        scores: DataFrame | None = None,
        min_hot_rows: int = MIN_HOT_ROWS,
        broadcast_rows: int = BROADCAST_ROWS,
        map_side_bytes: int = influence_ops.MAP_SIDE_BYTES,
    ):
        self._users, self._network, self._features, self.variant = users, network, features, variant
        self._scores = scores
        self.min_hot_rows, self.broadcast_rows, self.map_side_bytes = min_hot_rows, broadcast_rows, map_side_bytes

    @classmethod
    def of_accounts(cls, accounts: Input, network: Input, features: Input, variant: Variant, **options):
        users = partial(_study_users, accounts, variant) if callable(accounts) else user_ops.study_users(accounts, variant)
        return cls(users, network, features, variant, **options)

    @classmethod
    def of_trust(cls, scores: DataFrame, network: Input, features: Input, variant: Variant | None = None, **options):
        variant = variant or PRESETS["trust"]
        return cls(user_ops.trust_users(scores), network, features, variant, scores=scores, **options)

    @cached_property
    def network(self) -> DataFrame:
        return self._network() if callable(self._network) else self._network

    @cached_property
    def features(self) -> DataFrame:
        return self._features() if callable(self._features) else self._features

    # ---- users and edges -------------------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        """(id, is_core): everybody."""
        return looked_up(self._stored_users, self.user_count, self.broadcast_rows)

    @cached_property
    def _stored_users(self) -> DataFrame:
        return materialise(self._users() if callable(self._users) else self._users, "users")

    @cached_property
    def user_count(self) -> int:
        """N, from the file footers of the stage table; the bound of every table of one row per user."""
        return self._stored_users.count()

    def _per_user(self, table: DataFrame) -> DataFrame:
        return looked_up(table, self.user_count, self.broadcast_rows)

    @cached_property
    def scores(self) -> DataFrame | None:
        return None if self._scores is None else self._per_user(self._scores)

    @cached_property
    def people(self) -> Column:
        """N as a scalar subquery."""
        return self.users.agg(F.count(F.lit(1)).alias("people")).scalar()

    @cached_property
    def edges(self) -> DataFrame:
        """(source_id, dest_id, weight) from core users to anybody in the study.

        The core comes first: it is the strongest filter, and the copies of its edges are then combined
        where the filter's shuffle has left them.  A cap draws from the copies.
        """
        combined = network_ops.weighted(network_ops.from_core(self.network, self.users))
        known = network_ops.to_known(combined, self.users)
        if self.variant.friend_cap is not None:
            known = network_ops.cap_friends(known, self.variant.friend_cap, self.variant.seed)
        return materialise(known, "edges")

    @cached_property
    def degrees(self) -> DataFrame:
        return network_ops.degrees(self.users, self.edges)

    @cached_property
    def loaded(self) -> DataFrame:
        if not self.variant.restrict_to_loaded:
            return self.users.select("id")
        return self._per_user(user_ops.loaded_users(self.users, self.edges))

    @cached_property
    def kept(self) -> DataFrame:
        """(id, degree) of the compared users; for trust also whether their averages are unknown."""
        enough = self.degrees.where(F.col("degree") >= self.variant.min_degree)
        if self._scores is not None:
            known = self.averaged.select(F.col("user_id").alias("id"), F.lit(0).alias("unaveraged"))
            enough = enough.join(known, "id", "left").withColumn("unaveraged", F.coalesce("unaveraged", F.lit(1)))
        return self._per_user(materialise(enough, "kept"))

    @cached_property
    def _averaging(self) -> DataFrame:
        """(id, degree) of the kept users that get friend and baseline averages."""
        if self._scores is None:
            return self.kept
        return self.kept.where("unaveraged = 0").drop("unaveraged")

    # ---- topics ----------------------------------------------------------------------------------

    @cached_property
    def vocabulary(self) -> DataFrame:
        return feature_ops.vocabulary(self.features, self.variant.vocab_scope)

    def _cell_users(self) -> DataFrame:
        """(id, is_core) of the users whose scores are needed."""
        if not self.variant.restrict_to_loaded:
            return self.users
        return self._per_user(user_ops.loaded_flags(self.users, self.edges))

    @cached_property
    def _cells(self) -> DataFrame:
        features, users = together(lambda: self.features, self._cell_users)
        return materialise(feature_ops.cells(features, users), "cells")

    @cached_property
    def core_cells(self) -> DataFrame:
        return feature_ops.core_cells(self._cells)

    @cached_property
    def reference_cells(self) -> DataFrame:
        return feature_ops.reference_cells(self._cells)

    @cached_property
    def statistics(self) -> DataFrame:
        return feature_ops.topic_statistics(self.core_cells, self.reference_cells, self.people)

    @cached_property
    def topics(self) -> DataFrame:
        """Scales and population mean of every topic that varies in all slices.

        A varying topic has a row in slice 0, so the vocabulary scope needs no join here.
        """
        varying = feature_ops.varying_topics(self.statistics)
        return materialise(feature_ops.topic_scales(varying, self.variant.normalise), "topics")

    @cached_property
    def topic_count(self) -> int:
        """Exact, from the file footers of the stage table."""
        return self.topics.count()

    def attach_topics(self, rows: DataFrame, table: DataFrame, key: str, user: str) -> DataFrame:
        """Rows joined with a table of one row per topic, broadcast if the vocabulary is small enough."""
        return self.attach_small(rows, table, key, user, self.topic_count)

    def attach_small(self, rows: DataFrame, table: DataFrame, key: str, user: str, table_rows: int) -> DataFrame:
        """The same for a table of `table_rows` rows, unique on the key."""
        return attach_small(rows, table, key, table_rows, (user,), self.broadcast_rows)

    def _numbered(self, cells: DataFrame) -> DataFrame:
        """Cells of varying topics with the topic's number in place of its name."""
        return self.attach_topics(cells, self.topics.select("feat", "topic"), "feat", "group_id").drop("feat")

    def _named(self, rows: DataFrame) -> DataFrame:
        return self.attach_topics(rows, self.topics.select("topic", "feat"), "topic", "id")

    @cached_property
    def normalised(self) -> DataFrame:
        """(slice, group_id, feat, score, zero_score): restricted rows of varying topics, normalised.

        `zero_score` is what an absent cell of the topic becomes.
        """
        core, reference = self.core_cells, self.reference_cells
        stacked = [
            cells.where(F.col(f"s{number}").isNotNull()).select(
                F.lit(number).alias("slice"), "group_id", "feat", F.col(f"s{number}").alias("score")
            )
            for number, cells in ((0, core), (1, core), (2, reference))
        ]
        rows = reduce(DataFrame.unionByName, stacked)
        shift, divisor = F.col("shift"), F.col("divisor")
        return self.attach_topics(rows, self.topics.select("feat", "shift", "divisor"), "feat", "group_id").select(
            "slice",
            "group_id",
            "feat",
            ((F.col("score") - shift) / divisor).alias("score"),
            (-shift / divisor).alias("zero_score"),
        )

    # ---- friends and baseline --------------------------------------------------------------------

    @cached_property
    def averaged(self) -> DataFrame:
        """Trust only: users whose friend average is known."""
        return self._per_user(materialise(trust_ops.averaged_users(self.scores, self.edges), "averaged"))

    @cached_property
    def draws(self) -> DataFrame:
        """(source_id, dest_id, drawn): random people, as many as the user has friends."""
        drawers = self.degrees
        if self._scores is not None:
            drawers = drawers.join(self.averaged.select(F.col("user_id").alias("id")), "id", "left_semi")
        return draw_people(drawers, self.users, self.variant.seed, stage=True)

    @cached_property
    def friend_links(self) -> DataFrame:
        """(source_id, dest_id, friend_share) of kept users."""
        sharers = self._averaging.withColumnRenamed("id", "source_id")
        return self.edges.join(sharers, "source_id").select(
            "source_id", "dest_id", (F.col("weight") / F.col("degree")).alias("friend_share")
        )

    @cached_property
    def base_links(self) -> DataFrame:
        """(source_id, dest_id, base_share) of kept users."""
        drawn = draw_people(self._averaging, self.users, self.variant.seed, stage=True)
        return drawn.select("source_id", "dest_id", (1 / F.col("drawn")).alias("base_share"))

    @cached_property
    def links(self) -> DataFrame:
        if self.variant.baseline == "population":
            return self.friend_links
        friends = self.friend_links.withColumn("base_share", F.lit(0.0))
        drawn = self.base_links.withColumn("friend_share", F.lit(0.0))
        return friends.unionByName(drawn)

    @cached_property
    def _packed(self) -> influence_ops.Parts:
        return self.pack(self._numbered(self.reference_cells), self.topics, self.topic_count)

    def pack(self, cells: DataFrame, topics: DataFrame, topic_count: int) -> influence_ops.Parts:
        """Reference scores of numbered topics, packed: those copied to every task, and the rest that links are shuffled to."""
        shape = influence_ops.vector_shape(topics, self.user_count)
        if shape is None:
            blocks = influence_ops.score_blocks(topic_count)
            packed = influence_ops.packed_scores(cells, blocks)
        else:
            blocks, places = shape
            packed = influence_ops.packed_vectors(cells, places)
        return influence_ops.map_side_people(self.edges.select("dest_id"), materialise(packed, "packed"), blocks, self.map_side_bytes)

    @cached_property
    def _hot_friends(self) -> influence_ops.Hot:
        return self.hot_friends(self._packed[1])

    def hot_friends(self, light: DataFrame | None) -> influence_ops.Hot:
        """Users of the shuffled rest whose followers times blocks of topics make very many rows."""
        if light is None:
            return None, None
        return heavy_pairs(self.edges.select("dest_id"), light.select("dest_id"), "dest_id", self.min_hot_rows)

    def _neighbours(self, links: DataFrame, shares: list[str]) -> DataFrame:
        return influence_ops.neighbour_sums(links, *self._packed, shares, self._hot_friends)

    @cached_property
    def friend_averages(self) -> DataFrame:
        """(id, feat, friend_avg), not normalised; cells without a row are zero."""
        rows = self._neighbours(self.friend_links, ["friend_share"])
        averages = influence_ops.topic_averages(rows, "friend_share", "friend_avg")
        return self._named(averages).select("id", "feat", "friend_avg")

    @cached_property
    def base_averages(self) -> DataFrame:
        """(id, feat, base_avg) of the drawn people, not normalised; cells without a row are zero."""
        rows = self._neighbours(self.base_links, ["base_share"])
        averages = influence_ops.topic_averages(rows, "base_share", "base_avg")
        return self._named(averages).select("id", "feat", "base_avg")

    # ---- scores ----------------------------------------------------------------------------------

    @cached_property
    def own_cells(self) -> DataFrame:
        """(group_id, feat, s0, s1) of kept users; for trust also whether their averages are unknown."""
        return self.core_cells.join(self.kept.drop("degree").withColumnRenamed("id", "group_id"), "group_id")

    @cached_property
    def support(self) -> DataFrame:
        shares = ["friend_share"] + (["base_share"] if self.variant.baseline == "random" else [])
        own = self._numbered(self.own_cells)
        neighbours = self._neighbours(self.links, shares)
        return influence_ops.support_rows(own, neighbours, self.variant.baseline, self._scores is not None)

    @cached_property
    def user_flags(self) -> DataFrame:
        """One row per kept user with the flags of the support rows."""
        flag = F.lit(0) if self._scores is None else F.col("unaveraged")
        base = F.lit(1) if self.variant.baseline == "population" else flag
        return self.kept.select(flag.alias("friend_flag"), base.alias("base_flag"))

    @cached_property
    def moments(self) -> DataFrame:
        return influence_ops.moments(self._with_baseline(self.support), self.topics, self.user_flags)

    def _with_baseline(self, support: DataFrame) -> DataFrame:
        return self.attach_topics(support, self.topics.select("topic", "base_avg"), "topic", "id")

    @cached_property
    def deltas(self) -> DataFrame:
        """(id, feat, tt, tf, tr) in normalised scores, for the support rows of varying topics.

        Elsewhere tt is 0, and tf and tr are what the topic's constant baseline makes them.
        """
        a, divisor = F.col("base_avg"), F.col("divisor")
        return self.attach_topics(self.support, self.topics, "topic", "id").select(
            "id",
            "feat",
            (F.col("tt") / divisor).alias("tt"),
            ((F.col("x") + F.col("friend_flag") * a) / divisor).alias("tf"),
            ((F.col("y") + F.col("base_flag") * a) / divisor).alias("tr"),
        )

    @cached_property
    def cosines(self) -> DataFrame:
        return influence_ops.cosines(self.moments)

    @cached_property
    def fits(self) -> DataFrame:
        """Least-squares coefficients, intercept and error per topic.

        The coefficients need the means of the support rows, and the errors the coefficients, so these rows become a
        stage table.
        """
        if self._scores is not None:
            raise ValueError("the least-squares estimator is defined for account studies only")
        support = materialise(self.support, "support")
        sums = materialise(influence_ops.moments(self._with_baseline(support), self.topics, self.user_flags), "moments")
        flag = 1 if self.variant.baseline == "population" else 0

        def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
            return self.attach_topics(rows, table, "topic", "id")

        residuals = influence_ops.residual_sums(support, sums, flag, attach)
        solved = materialise(influence_ops.least_squares(sums, residuals), "fits")
        return influence_ops.fit_errors(support, solved, flag, attach)

    @cached_property
    def result(self) -> DataFrame:
        return self.fits if self.variant.estimator == "ols" else self.cosines

    @cached_property
    def counts(self) -> DataFrame:
        """(stage, n): the sizes of the sets along the way."""
        core = user_ops.core_of(self.users)
        stages = {
            "all_users": self.users,
            "core_users": core,
            "loaded_users": self.loaded,
            "kept_users": self.kept,
            "masked_users": self.degrees.where(F.col("degree") < self.variant.min_degree),
            "vocabulary": self.vocabulary,
            "kept_topics": self.topics,
        }
        sizes = [
            rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
            for stage, rows in stages.items()
        ]
        return reduce(DataFrame.unionByName, sizes)
