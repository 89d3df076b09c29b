"""The five study variants and the names of their tables and result files."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Variant:
    """Everything in which the five studies differ."""

    name: str
    all_level: int | None = 3
    core_level: int | None = 2
    min_statuses: int | None = 200
    min_friends: int | None = 25
    min_recorded: int | None = 0  # friends count that everybody needs; an unknown count fails, None is no test
    friend_cap: int | None = None
    restrict_to_loaded: bool = True
    vocab_scope: str = "all"  # "all": words of every slice, "first": words of slice 0
    normalise: str | None = None  # None, "minmax" or "variance"
    baseline: str = "population"  # "population" or "random"
    min_degree: int = 10
    estimator: str = "cosine"  # "cosine" or "ols"
    sinks: tuple[tuple[str, str, float], ...] = ()  # (result column, file name, threshold)
    seed: int = 42

    def with_depth(self, core_depth: int) -> Variant:
        """Core users up to `core_depth` crawl levels, friends one level further out."""
        return replace(self, core_level=core_depth, all_level=core_depth + 1)

    def but(self, **changes) -> Variant:
        return replace(self, **changes)


# Thresholds, caps and file names of the published study scripts.
PRESETS: dict[str, Variant] = {
    "minmax_population": Variant(
        name="minmax_population",
        vocab_scope="first",
        normalise="minmax",
        sinks=(
            ("cos_friends", "cs", 0.0),
            ("cos_base", "cs_r", 0.0),
            ("cos_diff", "cs_dif", 0.0),
            ("cos_diff", "cs_dif_01", 0.1),
            ("cos_diff", "cs_dif_02", 0.2),
        ),
    ),
    "ols_population": Variant(
        name="ols_population",
        normalise="minmax",
        estimator="ols",
        sinks=(("params", "params", 0.0), ("b_friends", "friends_param", 0.0)),
    ),
    "raw_population": Variant(
        name="raw_population",
        sinks=(
            ("cos_friends", "1_cs_23.csv", 0.0),
            ("cos_base", "1_cs_r_23.csv", 0.0),
            ("cos_diff", "1_cs_dif_23.csv", 0.0),
            ("cos_diff", "1_cs_dif_01_23.csv", 0.1),
            ("cos_diff", "1_cs_dif_02_23.csv", 0.2),
        ),
    ),
    "capped_random": Variant(
        name="capped_random",
        all_level=2,
        core_level=1,
        min_statuses=None,
        min_friends=None,
        min_recorded=None,
        friend_cap=100,
        normalise="variance",
        baseline="random",
        min_degree=6,
        sinks=(("cos_diff", "1_cos_sims_dif.csv", 0.0), ("cos_diff", "1_cos_sims_dif_0.05.csv", 0.05)),
    ),
    "trust": Variant(
        name="trust",
        all_level=None,
        core_level=None,
        min_statuses=None,
        min_friends=None,
        min_recorded=None,
        restrict_to_loaded=False,
        normalise="variance",
        baseline="random",
        min_degree=6,
        sinks=(
            ("cos_friends", "tr_cos_sims.csv", 0.0),
            ("cos_base", "tr_cos_sims_r.csv", 0.0),
            ("cos_diff", "tr_cos_sims_dif.csv", 0.05),
        ),
    ),
}

# The message tables behind the three slices.
CORE_HALVES = ("msg_1001_nrt_core_1", "msg_1001_nrt_core_2")
WHOLE_PERIOD = "msg_1001_nrt"
TERCILE_TABLES = {1: "msg_1001_nrt_1st", 2: "msg_1001_nrt_2nd"}
DEFAULT_TOPICS = "cat_met_a30_2000_cp_w"


def slice_tables(tercile: int = 0) -> tuple[str, str, str]:
    """Message tables of slices 0, 1 and 2; any tercile other than 1 or 2 means the whole period."""
    return (*CORE_HALVES, TERCILE_TABLES.get(tercile, WHOLE_PERIOD))


def feature_table_name(
    message_table: str,
    topics: str = DEFAULT_TOPICS,
    group: str = "user_id",
    occurrence: str = "16to16",
    suffix: str | None = None,
) -> str:
    """Name of the feature table of a topic set over a message table, e.g. feat$1to3gram$m$user_id$16to16$0_01."""
    parts = ["feat", topics, message_table, group, occurrence]
    return "$".join(parts if suffix is None else [*parts, suffix])


def result_name(variant: Variant, kind: str, tercile: int = 0) -> str:
    """File name of one result.  Variants run per tercile and depth build it; the others have fixed names."""
    if kind.endswith(".csv"):
        return kind
    return f"norm_{tercile}_{kind}_{variant.core_level}{variant.all_level}.csv"
