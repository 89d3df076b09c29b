import random
import re
from collections import Counter

import pytest

from langshift.llm.pivotal import dealt, mix, mix_documents, source_targets


def water_fill(sizes, share=1.5, most=2):
    """Targets by trying every set of stopped sources in order of their cap per weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_weight = sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_targets(spark):
    draw = random.Random(4)
    rows = [(i, None if i % 11 == 0 else f"s{draw.randint(0, 8)}" if i % 3 else "hot", draw.randint(0, 50)) for i in range(400)]
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "id long, source string, size long")).collect()}
    expected = water_fill(sizes)
    assert got.keys() == expected.keys()
    assert all(got[s] == pytest.approx(expected[s]) for s in got)


def test_mix_meets_targets_and_repeats(spark):
    draw = random.Random(5)
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", int(draw.paretovariate(2.5) * 20)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, source string, size long")
    got = mix(frame, block=64).collect()
    assert len(got) == len(rows)
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    again = mix(frame.repartition(11), block=64).collect()
    assert Counter(got) == Counter(again)


def test_expected_copies_are_the_fraction(spark):
    """Over many documents of one size the share that is doubled equals the fraction: no block is favoured."""
    rows = [(i, "a" if i % 2 else "b", 10) for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "id long, source string, size long"), block=128).collect()
    for source in "ab":
        copies = [r["copies"] for r in got if r["source"] == source]
        target = next(r["target"] for r in got if r["source"] == source)
        assert abs(sum(copies) * 10 - target) <= 10


def test_odd_rows(odd_docs, no_docs, odd_rows):
    got = mix_documents(odd_docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in odd_rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix_documents(no_docs).count() == 0
    assert {r["taken"] for r in mix_documents(odd_docs.where("text is null")).collect()} == {0}


def test_repeated_rows_spread_over_blocks(spark):
    rows = [(None, "a", 10, 3000)] * 1000 + [(7, "a", 20, 3000)] * 1000 + [(i, "a", 5, 3000) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, source string, size long, documents long").repartition(5)
    placed = dealt(frame, 100).collect()
    assert len(placed) == 3000 and len({r["order"] for r in placed}) == 3000
    assert max(Counter(r["block"] for r in placed).values()) < 200
    sizes = frame.select("id", "source", "size")
    assert Counter(mix(sizes, block=100).collect()) == Counter(mix(sizes.repartition(9), block=100).collect())
