import math
import random

import numpy as np
import pytest

from langshift.llm import range_join
from langshift.llm.components import connected_components
from langshift.llm.range_join import near_vectors


def brute(rows, least):
    ok = [
        r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
        for r in rows
    ]
    links = {i: [] for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    links[i].append(j)
                    links[j].append(i)
    result = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        result.append((rows[i][0], len(links[i]), first, rows[i][0] == first))
    return sorted(result, key=repr)


def vectors():
    draw = np.random.default_rng(2)
    rows = []
    for i in range(260):
        v = draw.normal(size=6) * draw.choice([0.01, 1, 50])
        rows.append((i, v.tolist(), int(i % 3)))
    centre = draw.normal(size=6)
    for i in range(260, 420):  # a dense group
        rows.append((i, (centre + 0.15 * draw.normal(size=6)).tolist(), 1))
    rows += [(i, rows[3][1], 0) for i in range(420, 450)]  # copies
    rows += [(500, None, 1), (501, [0.0] * 6, 1), (502, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0], 1), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(504, [math.inf] * 6, 1), (505, rows[0][1], None), (506, [1.0, 2.0], 0), (507, [2.0, 4.0], 0), (508, [], 0)]
    rows += [rows[3], (7, rows[8][1], 2), (None, rows[8][1], 2)]
    return rows


@pytest.mark.parametrize("cell", [2048, 16])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(range_join, "CELL_ROWS", cell)
    monkeypatch.setattr(range_join, "QUERY_ROWS", cell * 2)
    monkeypatch.setattr(range_join, "TARGET_ROWS", cell * 4)
    rows = vectors()
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node int, copies int")
    got = sorted((tuple(r) for r in near_vectors(frame, 0.93).collect()), key=repr)
    assert got == brute(rows, 0.93)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.93).count() == 0


def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 300)] + [(5, 5), (None, 3), (7, None)]
    links += [(draw.randint(1000, 1400), draw.randint(1000, 1400)) for _ in range(250)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize(("groups", "spread", "most"), [(12, 0.02, 1.3), (60, 0.02, 3.5), (60, 1.0, 12.0)])
def test_copies_of_a_class(spark, monkeypatch, groups, spread, most):
    """Vectors in as many groups as pivots visit about one cell, in more groups some, and all far apart up to every cell of their label."""
    monkeypatch.setattr(range_join, "CELL_ROWS", 64)
    draw = np.random.default_rng(7)
    middles = draw.normal(size=(groups, 16))
    rows = [(i % 3, 16, i, 1, (middles[i % groups] + spread * draw.normal(size=16)).tolist()) for i in range(1800)]
    classes = spark.createDataFrame(rows, "label int, dim int, node long, copies long, embedding array<double>")
    reach = math.sqrt(2 - 2 * 0.93)
    pivots = range_join.choose_pivots(classes, 1800, reach)
    assert sorted(pivots) == [(0, 16), (1, 16), (2, 16)]
    members = range_join._assigned(classes, pivots, reach)
    cells = sum(len(numbers) for numbers, _ in pivots.values()) / 3
    assert members.where("home").count() == 1800
    copies = members.count() / 1800
    assert copies <= min(most, cells), (copies, cells)


def test_every_label_of_a_small_table_has_a_pivot(spark):
    rows = [(label, 2, 10 * label + i, 1, [1.0, float(i)]) for label in range(5) for i in range(4 if label else 1)]
    classes = spark.createDataFrame(rows, "label int, dim int, node long, copies long, embedding array<double>")
    assert sorted(label for label, _ in range_join.choose_pivots(classes, len(rows), 0.3)) == [1, 2, 3, 4]
