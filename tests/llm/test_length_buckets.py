import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from langshift.llm.length_buckets import best_boundaries, pack, plan_buckets


def test_boundaries_are_optimal():
    draw = random.Random(6)
    for _ in range(40):
        lengths = sorted(draw.sample(range(200), draw.randint(1, 9)))
        rows = [draw.randint(1, 30) for _ in lengths]
        for buckets in (1, 2, 3, 12):
            found = best_boundaries(np.array(lengths), np.array(rows), buckets)
            cost = lambda bounds: sum(n * min(b for b in bounds if b >= x) for x, n in zip(lengths, rows))  # noqa: E731, B023
            choices = (c for k in range(1, buckets + 1) for c in itertools.combinations(lengths, min(k, len(lengths))) if c[-1] == lengths[-1])
            assert found[-1] == lengths[-1] and len(found) <= buckets
            assert cost(found) == min(map(cost, choices))


def test_batches(spark, odd_docs, odd_rows):
    rows = pack(odd_docs, buckets=4, budget=400).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["padded"]
        batches[r["batch"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for batch in batches.values():
        assert len({(r["bucket"], r["padded"]) for r in batch}) == 1
        assert sorted(r["slot"] for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0]["padded"] <= 400
    partial = Counter(b[0]["bucket"] for b in batches.values() if len(b) < max(1, 400 // max(1, b[0]["padded"])))
    assert max(partial.values()) <= 1  # all batches of a bucket but one are full
    assert Counter(rows) == Counter(pack(odd_docs.repartition(7), buckets=4, budget=400).collect())


def test_plan_counts_everything(spark):
    frame = spark.range(5000).select((F.col("id") % 700).alias("n_tokens"))
    plan = plan_buckets(frame, 8, 1000)
    assert plan.boundary[-1] == 699 and len(plan.boundary) == 8


def test_empty(no_docs):
    assert pack(no_docs).count() == 0


def least_padded(lengths, rows, buckets):
    """Least total of rows times boundary, by trying every start of the last bucket."""
    before = [0, *itertools.accumulate(rows)]
    cost = [0] + [float("inf")] * len(lengths)
    for _ in range(buckets):
        cost = [0] + [min(cost[i] + lengths[j - 1] * (before[j] - before[i]) for i in range(j)) for j in range(1, len(cost))]
    return cost[-1]


def test_boundaries_are_optimal_over_long_lengths():
    draw = random.Random(7)
    for n in (150, 300):
        lengths = sorted(draw.sample(range(20_000), n))
        rows = [draw.choice((1, 2, 3, 50, 5000)) for _ in lengths]
        for buckets in (2, 5, 16):
            found = best_boundaries(np.array(lengths), np.array(rows), buckets)
            cost = sum(n * min(b for b in found if b >= x) for x, n in zip(lengths, rows))
            assert len(found) <= buckets and cost == least_padded(lengths, rows, buckets)


def test_plan_is_optimal_with_a_hot_length_at_the_low_end_of_a_bin(spark):
    counts = {300: 9, 700: 40, 2048: 5000, 2049: 5, 2060: 3, 2061: 2, 9000: 1}
    frame = spark.createDataFrame([(x,) for x, n in counts.items() for _ in range(n)], "n_tokens long")
    boundary = plan_buckets(frame, 4).boundary
    assert 2048 in boundary
    assert sum(n * min(b for b in boundary if b >= x) for x, n in counts.items()) == least_padded(list(counts), list(counts.values()), 4)


def test_many_copies_of_a_row_stay_whole(spark):
    rows = [(None, "one two three")] * 3000 + [(7, "one two three")] * 500 + [(8, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = pack(docs, buckets=2, budget=30).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, 3 if t else 0) for i, t in rows)
    places = Counter((r["batch"], r["slot"]) for r in got)
    assert max(places.values()) == 1 and Counter(got) == Counter(pack(docs.repartition(2), buckets=2, budget=30).collect())
