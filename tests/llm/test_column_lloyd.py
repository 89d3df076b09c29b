import hashlib
import math
import random

import numpy as np
import pytest

from langshift.llm.column_lloyd import LIMIT, assign, cluster, column_blocks, update

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, shard int, block long"


def brute(rows, k, rounds, dim, scale=1024):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [max(-LIMIT, min(LIMIT, math.floor(scale * c))) for c in x]))
    name = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=name)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(centroids)), key=lambda i: (far(x, centroids[i]), i))
    for _ in range(rounds):
        labels = [nearest(x) for _, x in kept]
        for i in range(len(centroids)):
            own = [x for (_, x), label in zip(kept, labels) if label == i]
            if own:
                centroids[i] = [sum(c) // len(own) for c in zip(*own)]
    labels = [nearest(x) for _, x in kept]
    distances = [far(x, centroids[i]) for (_, x), i in zip(kept, labels)]
    inertia = [sum(d for d, i in zip(distances, labels) if i == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = 2**63 - 1
    return [(v, i, d, min(inertia[i], top), min(sum(inertia), top), sha[i]) for (v, _), i, d in zip(kept, labels, distances)]


def vectors(dim, n=150):
    draw = random.Random(9)
    f32 = lambda x: float(np.float32(x))
    middles = [[draw.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [f32(m + draw.gauss(0, 0.2)) for m in draw.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a third of all rows are one vector
    rows += [rows[3], rows[3], (4, rows[5][1]), (None, rows[6][1]), (None, [0.0] * dim)]
    rows += [(2000, None), (2001, []), (2002, [0.5] * (dim - 1)), (2003, [None] * dim), (2004, [math.nan] * dim), (2005, [math.inf] * dim)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, 3) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("dim", "width", "block"), [(10, 4, 16), (16, 16, 4096)])
def test_clusters_equal_brute_force(spark, dim, width, block):
    rows = vectors(dim)
    got = cluster(frame(spark, rows), k=5, rounds=4, dim=dim, width=width, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 5, 4, dim), key=repr)


def test_ties_empty_clusters_and_ends(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(10, [1e30, -1e30]), (11, [3e38, -3e38]), (12, [0.001, -0.0005])]
    got = cluster(frame(spark, rows), k=4, rounds=2, dim=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 4, 2, 2))
    few = rows[:2]
    assert sorted(map(tuple, cluster(frame(spark, few), k=4, rounds=1, dim=2).collect())) == sorted(brute(few, 4, 1, 2))


def test_rounds_do_not_move_the_vectors(spark):
    """The written column blocks are joined with labels and read for distances without an exchange of their own."""
    rows = spark.createDataFrame([(i, [i % 7, i % 11, i % 5, i]) for i in range(3000)], "id long, ints array<int>")
    columns = column_blocks(rows, 4, 2, 64)
    centroids = np.array([[0, 0, 0, 0], [3, 3, 3, 1500]], np.int64)
    labels = assign(columns, centroids, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = columns.select("shard", "block", "data").join(labels.selectExpr("block", "labels", "explode(sequence(0, 1)) as shard"), ["shard", "block"])
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
        new = update(columns, labels, centroids, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    x = np.array([r["ints"] for r in rows.collect()])
    label = ((x[:, None] - centroids) ** 2).sum(2).argmin(1)
    assert new.tolist() == [[int(s) // (label == c).sum() for s in x[label == c].sum(0)] for c in (0, 1)]


def test_empty(spark):
    assert cluster(frame(spark, []), dim=3).count() == 0
