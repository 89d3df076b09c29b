"""Connected components by contraction: every job is a shuffle over what is left of the links.

Each round a node adopts the smallest of itself and its neighbours; the chains that arise are shortened to their ends,
and only links between different ends go on to the next round.  Links, nodes and labels stay distributed.  Minima are
combined before the shuffle, and a node that very many others adopt stands on one side of joins only, where the
adaptive skew join can split it, because both sides are written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langshift.operators.storage import materialise


def _shortened(parents: DataFrame) -> DataFrame:
    """(node, parent) with every chain replaced by its end."""
    while True:
        above = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
        hop = parents.join(above.where("_node != _parent"), F.col("parent") == F.col("_node"), "left")
        longer = materialise(
            hop.select("node", F.coalesce("_parent", "parent").alias("parent"), F.col("_parent").isNotNull().alias("moved")),
            "parents",
        )
        parents = longer.select("node", "parent")
        if longer.where("moved").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (src, dst); component is the smallest node reachable.

    Links may repeat, point either way and join a node to itself; those with a null end are ignored.
    """
    links = links.select("src", "dst").where("src is not null and dst is not null")
    labels = None
    while True:
        both = links.select(F.explode(F.array(
            F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
            F.struct(F.col("dst").alias("node"), F.col("src").alias("other")),
        )).alias("e")).select("e.*")
        adopted = both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"))
        ends = _shortened(materialise(adopted, "adopted"))
        if labels is None:
            labels = ends.select("node", F.col("parent").alias("component"))
        else:
            step = ends.select(F.col("node").alias("component"), "parent")
            labels = labels.join(step, "component", "left")
            labels = labels.select("node", F.coalesce("parent", "component").alias("component"))
            labels = materialise(labels, "labels")
        left = ends.select(F.col("node").alias("src"), F.col("parent").alias("_src"))
        right = ends.select(F.col("node").alias("dst"), F.col("parent").alias("_dst"))
        moved = links.join(left, "src").join(right, "dst").where("_src != _dst")
        links = materialise(moved.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "links")
        if links.isEmpty():
            return labels
