"""Near-duplicate vectors by an exact metric range join around pivots.

Vectors are compared on the unit sphere, where a cosine threshold is a distance.  Equal vectors of a label are one
class.  Every label has at least one pivot, and pivots partition the label's classes into cells.  A class also goes as
a guest to every cell in which a member could lie within the range: its distance to the pivot exceeds the cell's radius
by at most the range (triangle inequality), and it lies no further than the range behind the plane that halves the
way between its own pivot and that one (a member of the cell lies on the other side).  Members within half the range of
their pivot all link to each other, so a dense group of near copies costs one sum, not its pairs.  All other pairs meet
in exactly one block of their home cell's grid of (members, candidates), and cells are joined independently.  In a
block both sides stand in order of their distance to the pivot, and a member is compared only with those whose distance
differs by the range at most.  A block reports counts and a spanning forest, never all pairs.

Pivots are a bounded sample thinned to lie further apart than the range; every class is joined whatever the sample.
How many cells a class visits depends on the vectors: few where they form groups, many where all lie about equally
far apart, as unit vectors in many dimensions do, since no distance then excludes much.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or has no label, links
with nothing; vectors of different length do not link; repeated rows and repeated ids are vectors of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.llm.components import connected_components
from langshift.llm.forest import Forest
from langshift.operators.storage import materialise

CELL_ROWS = 2048  # classes per pivot that the sample aims at
MAX_PIVOTS = 4096
QUERY_ROWS = 1024  # of a block
TARGET_ROWS = 4096
WINDOW_ROWS = 128  # members compared with one stretch of candidates
SLACK = 1e-7  # distances are kept this much on the safe side
_CELL = ("label", "dim", "cell")


def usable(embedding: Column) -> Column:
    """Not null, not empty, not zero, every component finite."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


Pivots = dict[tuple[object, int], tuple[np.ndarray, np.ndarray]]


def choose_pivots(classes: DataFrame, rows: int, apart: float) -> Pivots:
    """(label, dim) -> cell numbers and unit vectors: a sample by hash, no two of a label within `apart`.

    One class of each label that has several (of the largest labels, if there are more than MAX_PIVOTS), and one in
    about CELL_ROWS of all.  At most about 3 * MAX_PIVOTS rows come to the driver, whatever the number of classes.
    """
    share = max(CELL_ROWS, math.ceil(rows / MAX_PIVOTS))
    place = F.xxhash64("embedding")
    one = F.min_by(F.struct("node", "embedding"), F.struct(place, "node"))
    spaces = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), one.alias("one")).where("n > 1")
    first = spaces.orderBy(F.desc("n"), "label", "dim").limit(MAX_PIVOTS).select("label", "dim", "one.node", "one.embedding").collect()
    more = classes.where(F.pmod(place, F.lit(share)) == 0).select("label", "dim", "node", "embedding").limit(2 * MAX_PIVOTS).collect()
    drawn = {row["node"]: row for row in [*first, *more]}.values()
    chosen: dict[tuple[object, int], list[np.ndarray]] = {}
    for row in sorted(drawn, key=lambda r: r["node"]):
        unit = _unit(np.array([row["embedding"]], np.float64))
        taken = chosen.setdefault((row["label"], row["dim"]), [])
        if not taken or _distances(unit, np.vstack(taken)).min() > apart:
            taken.append(unit)
    result, number = {}, 0
    for space, units in chosen.items():
        result[space] = np.arange(number, number + len(units)), np.vstack(units)
        number += len(units)
    return result


def _to_pivots(batch: pa.RecordBatch, pivots: Pivots) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, cell numbers, pivots, distances) per label and length; a label without pivots has one cell, -1."""
    labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
    spaces: dict[tuple[object, int], list[int]] = {}
    for i, space in enumerate(zip(labels, dims, strict=True)):
        spaces.setdefault(space, []).append(i)
    for (label, dim), rows in spaces.items():
        unit = _unit(_matrix(batch.column("embedding").take(pa.array(rows)), dim))
        cells, vectors = pivots.get((label, dim)) or (np.array([-1]), np.eye(1, dim))
        yield np.array(rows), cells, vectors, _distances(unit, vectors)


def _radii(classes: DataFrame, pivots: Pivots) -> dict[int, float]:
    """Largest distance of a home member for each cell that has a pivot; at most one row per pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, cells, _, far in _to_pivots(batch, pivots):
                yield pa.RecordBatch.from_pydict({"cell": cells[far.argmin(axis=1)], "far": far.min(axis=1)})

    homes = classes.select("label", "dim", "embedding").mapInArrow(run, "cell long, far double")
    return {r["cell"]: r["far"] for r in homes.where("cell >= 0").groupBy("cell").agg(F.max("far").alias("far")).collect()}


def _assigned(classes: DataFrame, pivots: Pivots, reach: float) -> DataFrame:
    """Every class at home in its nearest cell, and as a guest wherever a partner could be at home."""
    radii = _radii(classes, pivots)
    schema = classes.select("label", "dim", "node", "copies", "embedding").schema
    schema = schema.add("cell", "long").add("home", "boolean").add("ball", "boolean").add("far", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, cells, vectors, far in _to_pivots(batch, pivots):
                nearest = far.argmin(axis=1)
                own = far[np.arange(len(rows)), nearest]
                radius = np.array([radii.get(int(c), math.inf) for c in cells])
                between = _distances(vectors, vectors)[nearest]
                behind = (far**2 - own[:, None] ** 2) <= 2 * between * (reach + SLACK) + SLACK
                goes = behind & (far <= radius + reach + SLACK)
                goes[np.arange(len(rows)), nearest] = True
                who, where = np.nonzero(goes)
                home = where == nearest[who]
                out = batch.take(pa.array(rows[who]))
                ball = home & (own[who] <= reach / 2 - SLACK)
                for name, column in (("cell", cells[where]), ("home", home), ("ball", ball), ("far", far[who, where])):
                    out = out.append_column(name, pa.array(column))
                yield out

    narrow = classes.select("label", "dim", "node", "copies", "embedding")
    return materialise(narrow.mapInArrow(run, schema), "range-cells")


def _compare(least: float, reach: float) -> Callable[[pa.Table], pa.Table]:
    """Links between the queries and the targets of one block."""

    def run(table: pa.Table) -> pa.Table:
        asks, far = table["asks"].to_numpy(), table["far"].to_numpy()
        dim = table["dim"][0].as_py()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy().astype(np.float64)
        home, ball = table["home"].to_numpy(), table["ball"].to_numpy()
        by_far = np.argsort(far, kind="stable")
        q, t = by_far[asks[by_far]], by_far[~asks[by_far]]
        names, place = np.unique(node, return_inverse=True)
        links, forest = np.zeros(len(names)), Forest(len(names))
        unit = _unit(_matrix(table["embedding"], dim)) if len(q) and len(t) else None
        for at in range(0, len(q) if len(t) else 0, WINDOW_ROWS):
            part = q[at : at + WINDOW_ROWS]
            low = np.searchsorted(far[t], far[part[0]] - reach - SLACK)
            high = np.searchsorted(far[t], far[part[-1]] + reach + SLACK, "right")
            near = t[low:high]
            linked = (unit[part] @ unit[near].T >= least) & (node[part][:, None] != node[near][None, :])
            x, y = np.nonzero(linked)
            np.add.at(links, place[part[x]], copies[near[y]])
            back = ball[part[x]] & home[near[y]]  # ball members are never targets, so their partners learn of them here
            np.add.at(links, place[near[y[back]]], copies[part[x[back]]])
            forest.merge(place[part[x]], place[near[y]])
        counted, joined = np.flatnonzero(links), np.flatnonzero(forest.label != np.arange(len(names)))
        none = pa.nulls(len(counted), pa.int64())
        return pa.table({
            "src": np.concatenate((names[counted], names[joined])),
            "dst": pa.concat_arrays([none, pa.array(names[forest.label[joined]], pa.int64())]),
            "links": pa.concat_arrays([pa.array(links[counted].astype(np.int64)), pa.nulls(len(joined), pa.int64())]),
        })

    return run


def range_links(classes: DataFrame, rows: int, least: float) -> DataFrame:
    """(src, dst, links): partial link counts of classes (dst null) and links that connect what all links connect."""
    reach = math.sqrt(2 - 2 * least)
    pivots = choose_pivots(classes, rows, reach)
    members = _assigned(classes, pivots, reach)
    target = F.col("home") & F.col("ball")
    sizes = members.groupBy(*_CELL).agg(
        F.count_if("home").alias("homes"),
        F.count_if(~target).alias("targets"),
        F.sum(F.when(F.col("ball"), F.col("copies"))).alias("ball_copies"),
        F.min(F.when(F.col("ball"), F.col("node"))).alias("ball_node"),
    )
    sizes = materialise(sizes, "range-sizes")
    inside = members.where("ball").drop("embedding").join(sizes, [*_CELL])
    none = F.lit(None).cast("long")
    in_ball = inside.select(F.col("node").alias("src"), none.alias("dst"), (F.col("ball_copies") - F.col("copies")).alias("links"))
    star = inside.where("node != ball_node").select(F.col("node").alias("src"), F.col("ball_node").alias("dst"), none.alias("links"))

    def parts(rows: Column, size: int) -> Column:
        return F.ceil(rows / size).cast("int")

    grid = sizes.where("targets > 0 and homes > 0").select(
        *_CELL, parts(F.col("homes"), QUERY_ROWS).alias("across"), parts(F.col("targets"), TARGET_ROWS).alias("down")
    )
    placed = members.join(grid, [*_CELL])
    block = F.pmod(F.xxhash64("node"), F.col("across")).cast("int")
    bank = F.pmod(F.xxhash64("node", F.lit(1)), F.col("down")).cast("int")
    kept = [*_CELL, "node", "copies", "home", "ball", "far", "embedding"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = placed.where("home").select(*kept, F.lit(True).alias("asks"), block.alias("block"), every("down").alias("bank"))
    targets = placed.where(~target).select(*kept, F.lit(False).alias("asks"), every("across").alias("block"), bank.alias("bank"))
    blocks = queries.unionByName(targets).groupBy(*_CELL, "block", "bank")
    found = blocks.applyInArrow(_compare(least, reach), "src long, dst long, links long")
    return materialise(found.unionByName(in_ball).unionByName(star), "range-links")


def near_vectors(rows: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row; links join equal labels with a cosine of `least` or more."""
    named = rows.select(F.col(key).alias("id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    named = named.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull())
    stored = materialise(named.withColumn("node", F.monotonically_increasing_id()), "range-rows")
    valid = stored.where("ok")
    classes = valid.groupBy("label", "embedding").agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")
    )
    classes = materialise(classes.withColumn("dim", F.size("embedding")), "range-classes")
    found = range_links(classes, classes.count(), least)
    counts = found.where("links is not null").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("dst is not null").select("src", "dst"))
    rooted = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "embedding", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("root"),
    )
    rooted = materialise(rooted, "range-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = materialise(rooted.join(smallest, "root").select("label", "embedding", "n_links", "component_id"), "range-whole")
    linked = valid.join(whole, ["label", "embedding"]).select("id", "n_links", "component_id")
    alone = stored.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
