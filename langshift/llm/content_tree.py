"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node that either belongs to the main text or does not.  A node's own look (amount of
text, share of links, words of its class and id) gives evidence for one or the other, and a potential that depends on
the node's element name ties it to its parent.  Messages are passed once from the leaves up and once from the root down; their product is each node's exact
marginal, and text stands in the result if its node is more likely main text than not.

Evidence and potentials are estimated from labelled pages: their counts are sums over all nodes, which Spark adds up,
and the model is a small table (one row per feature seen).

Defined results: a null or empty page has the empty text; a page without markup is one node; cut-off and unclosed
markup is repaired; very long pages are read whole; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langshift.llm.dom_tree import Node, Page, joined, look, parse

SMOOTHING = 1.0
CLIP = 6.0  # bound on the evidence of one feature, in log odds
WEIGHT = 0.4  # of looks: those of siblings depend on each other, so each counts for less than one observation
KINDS = 20  # looks that an element name is smoothed over
OTHER = "*"  # stands for element names, classes and ids that the labelled pages don't have
RARE = 2  # a class or id seen no more often counts as one that is not known


def true_labels(page: Page) -> list[int | None]:
    """Label of each node of a labelled page: its own mark, else its parent's; a node outside all marks goes by its text.

    A container outside all marks is main text if most of the text below it is; without text it has no label.
    """
    nodes = page.nodes
    label: list[int | None] = []
    for node in nodes:
        label.append(int(node.marked) if node.marked else label[node.parent] if node.parent >= 0 else None)
    good, whole = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        good[i] += nodes[i].own if label[i] == 1 else 0
        whole[i] += nodes[i].own
        if nodes[i].parent >= 0:
            good[nodes[i].parent] += good[i]
            whole[nodes[i].parent] += whole[i]
    return [x if x is not None else int(2 * good[i] > whole[i]) if whole[i] else None for i, x in enumerate(label)]


Tie = tuple[tuple[float, float], tuple[float, float]]


@dataclass(frozen=True)
class Model:
    """Log odds of looks and names, log potentials [parent][child] by element name, and log odds of the root."""

    odds: dict[str, float]
    ties: dict[str, Tie]
    root: float


def kind(node: Node) -> str:
    """Elements that carry a class or id are a kind of their own."""
    return node.tag + "." * bool(node.names)


def _node_keys(node: Node, above: int | None) -> list[str]:
    """What is counted of a labelled node."""
    keys = [f"look={look(node)}", f"tag={node.tag}", *(f"name={name}" for name in node.names)]
    if node.names:
        keys.append("named")
    if node.parent < 0:
        keys.append("root")
    elif above is not None:
        keys += [f"tie{above}={kind(node)}", f"tie{above}={OTHER}"]
    return keys


def train(labelled: DataFrame, html: str = "html") -> Model:
    """Estimate the model from labelled pages (data-main marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                page = parse(text or "")
                labels = true_labels(page)
                for node, label in zip(page.nodes, labels, strict=True):
                    if label is not None:
                        above = labels[node.parent] if node.parent >= 0 else None
                        counts.update((key, label) for key in _node_keys(node, above))
        rows = [(key, label, n) for (key, label), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "label", "n"]) if rows else _NONE

    sums = labelled.select(html).mapInArrow(run, "key string, label long, n long").groupBy("key", "label").agg(F.sum("n").alias("n"))
    found: dict[str, list[float]] = {}
    for row in sums.collect():  # two rows per key of the labelled pages
        found.setdefault(row["key"], [0.0, 0.0])[row["label"]] = float(row["n"])
    return estimate(found)


def estimate(found: dict[str, list[float]]) -> Model:
    """The model from the counts [not main, main] of each key."""

    def odds(key: str, base: str, kinds: int) -> float:
        (no, yes), (all_no, all_yes) = found[key], found.get(base, [0.0, 0.0])
        ratio = (yes + SMOOTHING) / (all_yes + kinds * SMOOTHING) * (all_no + kinds * SMOOTHING) / (no + SMOOTHING)
        return max(-CLIP, min(CLIP, math.log(ratio)))

    def tie(tag: str) -> Tie:
        rows = []
        for parent in (0, 1):
            counts = [x + SMOOTHING for x in found.get(f"tie{parent}={tag}", [0.0, 0.0])]
            rows.append(tuple(math.log(x / sum(counts)) for x in counts))
        return rows[0], rows[1]

    top = [x + SMOOTHING for x in found.get("root", [0.0, 0.0])]
    known = {key: odds(key, f"tag={key[5:].split(',')[0]}", KINDS) for key in found if key.startswith("look=")}
    rare = [key for key in found if key.startswith("name=") and sum(found[key]) <= RARE]
    found[f"name={OTHER}"] = [sum(found[key][label] for key in rare) for label in (0, 1)]
    known |= {key: odds(key, "named", KINDS) for key in found if key.startswith("name=") and key not in rare}
    tags = {key.partition("=")[2] for key in found if key.startswith("tie")} | {OTHER}
    return Model(known, {tag: tie(tag) for tag in tags}, math.log(top[1] / top[0]))


_NONE = pa.RecordBatch.from_pydict(
    {"key": [], "label": [], "n": []}, schema=pa.schema([("key", pa.string()), ("label", pa.int64()), ("n", pa.int64())])
)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(page: Page, model: Model) -> list[float]:
    """Log odds of every node being main text, by sum-product messages up and down the tree."""
    nodes, odds = page.nodes, model.odds
    ties = [model.ties.get(kind(node)) or model.ties[OTHER] for node in nodes]
    # evidence of a node and of all that is below it
    other = odds.get(f"name={OTHER}", 0.0)
    below = [WEIGHT * odds.get(f"look={look(x)}", 0.0) + sum(odds.get(f"name={name}", other) for name in x.names) for x in nodes]
    up = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        (no_no, no_yes), (yes_no, yes_yes) = ties[i]
        up[i] = _log_sum(yes_no, yes_yes + below[i]) - _log_sum(no_no, no_yes + below[i])
        below[nodes[i].parent] += up[i]
    result = below[:]
    result[0] += model.root
    for i in range(1, len(nodes)):
        (no_no, no_yes), (yes_no, yes_yes) = ties[i]
        rest = result[nodes[i].parent] - up[i]  # what the parent knows without this child
        result[i] = below[i] + _log_sum(no_yes, yes_yes + rest) - _log_sum(no_no, yes_no + rest)
    return result


def main_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = parse(html)
    return joined(page, [odds > 0 for odds in marginals(page, model)])


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast((model.odds, model.ties, model.root))
    schema = T.StructType([
        pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=schema.names)

    return pages.select(key, url, html).mapInArrow(run, schema)
