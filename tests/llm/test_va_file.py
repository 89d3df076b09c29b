import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from langshift.llm import va_file
from langshift.llm.va_file import cell_edges, encode, top_k

LONG = 2**63


def brute(rows, k):
    usable = [
        (r[0], [max(-LONG + 1024, min(LONG - 1024, math.floor(64 * x))) for x in r[1]]) for r in rows
        if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    result = Counter()
    for i, (q, a) in enumerate(usable):
        if q % 20:
            continue
        scored = [
            (-max(-LONG, min(LONG - 1, sum(x * y for x, y in zip(a, b)))), v)
            for j, (v, b) in enumerate(usable) if j != i and len(a) == len(b)
        ]
        result.update((q, n + 1, v, -s) for n, (s, v) in enumerate(sorted(scored)[:k]))
    return result


def test_cells_hold_their_numbers():
    low, high = cell_edges()
    x = np.concatenate([np.arange(-3000, 3001), [2**k + d for k in range(12, 62) for d in (-1, 0, 1)], [-(2**62), LONG - 1024]])
    at = encode(x).astype(int) + 127
    assert ((low[at] <= x) & (x <= high[at])).all()


def vectors():
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=8) * draw.choice([0.1, 1.0, 30.0])).tolist()) for i in range(400)]
    rows += [(i, rows[20][1]) for i in range(400, 520)]  # a frequent vector, queries among them
    rows += [(i, draw.integers(-1, 2, 8).astype(float).tolist()) for i in range(520, 640)]  # many ties
    rows += [(640, None), (660, []), (680, [1.0, math.nan] * 4), (700, [None] * 8), (720, [math.inf] * 8), (740, [1.0, 2.0]), (760, [3.0, 4.0]), (761, [1e-3, 0.0])]
    rows += [(780, [1e12] * 8), (800, [-1e12] * 8), rows[40], rows[40], (None, rows[1][1])]
    return rows


@pytest.mark.parametrize("block", [8192, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(va_file, "CLASS_ROWS", block)
    monkeypatch.setattr(va_file, "QUERY_ROWS", block // 4)
    monkeypatch.setattr(va_file, "CHUNK", block // 2)
    monkeypatch.setattr(va_file, "GROUP", 16)
    rows = vectors()
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, dim int, class int").repartition(4)
    got = Counter(tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)


def test_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], kind)
    got = [tuple(r) for r in top_k(few, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 6144), (0, 2, 2, 6144)]
    assert top_k(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0, 20).count() == 0


def copied_rows(frame):
    """Rows of each broadcast that running the frame makes."""
    frame.collect()
    found, plans = [], [frame._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(plan.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_copies_to_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(va_file, "CLASS_ROWS", 16)
    monkeypatch.setattr(va_file, "QUERY_ROWS", 4)
    monkeypatch.setattr(va_file, "QUERY_BYTES", 3000, raising=False)
    written, write = {}, va_file.materialise

    def kept(frame, name):
        written.setdefault(name, []).append(frame)
        return write(frame, name)

    monkeypatch.setattr(va_file, "materialise", kept)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = Counter(tuple(r) for r in top_k(frame, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)
    queries, approximations = (written[name][0].count() for name in ("va-queries", "va-approximations"))
    assert 4 <= queries < approximations / 3
    copied = [copied_rows(scan) for name in ("va-floors", "va-reached") for scan in written[name]]
    assert max(map(max, copied)) < queries  # neither side is copied once per block of the other
    assert len(copied) > 2  # the queries met the table in several parts
