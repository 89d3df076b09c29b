"""Writing all result files of a variant."""

from __future__ import annotations

from pyspark.sql import DataFrame

from langshift.config import Variant, result_name
from langshift.operators.storage import materialise
from langshift.plans.study import Study
from langshift.sources.sinks import score_lines, vector_lines, write_lines

FIT_COLUMNS = ["b_friends", "b_base", "intercept", "mae"]


def export_result(variant: Variant, result: DataFrame, folder: str, tercile: int = 0) -> list[str]:
    """One folder of lines per result of the variant; returns their paths."""
    paths = []
    for column, kind, threshold in variant.sinks:
        path = f"{folder}/{result_name(variant, kind, tercile)}"
        if column == "params":
            write_lines(vector_lines(result, "feat", FIT_COLUMNS), path)
        else:
            write_lines(score_lines(result, "feat", column, threshold), path)
        paths.append(path)
    return paths


def export_study(study: Study, folder: str, tercile: int = 0) -> list[str]:
    """Compute a study once and write all its results."""
    return export_result(study.variant, materialise(study.result, "result"), folder, tercile)
