"""Headline queries, timed one after another; prints one JSON line.

"study_inputs" is the writing of the derived input tables, which the studies then read.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local threads, BENCH_QUERIES an optional
comma-separated selection ("all" for every registered query).
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from langshift.fixtures import Fixture
from langshift.queries import QUERIES, run, study_inputs

HEADLINE = (
    "topic_influence",
    "topic_influence_tercile1",
    "topic_influence_raw",
    "topic_influence_random",
    "topic_influence_trust",
    "topic_ols",
    "topic_deltas",
    "friend_topic_avg",
    "slice_topic_stats",
    "features_minmax_norm",
    "edges_core",
    "random_people",
    "trust_diffs",
    "message_positions",
    "first_tercile_messages",
    "message_parts",
    "accounts_last_message",
    "friend_messages",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("langshift-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run("users_all", spark, folder).write.format("noop").mode("overwrite").save()  # start the engine

    seconds = {}
    start = time.perf_counter()
    inputs = study_inputs(Fixture(spark, folder))
    for table in (inputs.network, inputs.accounts, inputs.trust_scores, inputs.features(0), inputs.features(1)):
        table.count()
    seconds["study_inputs"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()

    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
