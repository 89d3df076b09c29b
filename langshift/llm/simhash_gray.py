"""SimHash near-duplicates through a Gray-order hierarchical index.

`fingerprints` reduces each whole text to 64 bits.  `gray_components` links distinct fingerprints that differ in at
most three bits and returns the smallest document of everything that links, directly or through others.

Two fingerprints within three bits agree on at least one of four runs of the bits.  So each distinct fingerprint goes
to four groups, one per run, and groups are independent.  A group with too many members is dealt anew by four runs of
the bits that its members may still differ in, until it is small: no task gets an unbounded group, and no link is
lost.  Inside a group the fingerprints are sorted by Gray rank and become a tree whose upper nodes stand for the bit
patterns their members share; whole pairs of nodes are dropped once the differences between their patterns add up to
more than three, or once all their members are known to belong together.  A group reports a spanning forest (fewer
links than members), never all pairs.

Defined results: a null or blank text has fingerprint zero, which links like any other; repeated rows and repeated
doc_ids are rows of their own and share the fingerprint's component; an empty table gives an empty result; columns
other than doc_id and text are ignored; a null doc_id keeps its row and is never the smallest of a group that has
another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from langshift.llm.components import connected_components
from langshift.llm.forest import Forest
from langshift.operators.storage import materialise

BITS = 64
MAX_DISTANCE = 3
SEED = 42
SHINGLE = 3
GROUP_LIMIT = 2048  # members beyond which a group is dealt anew
MAX_DEALS = 5
STEP = 8  # bits of the pattern that a tree level adds
CHUNK_PAIRS = 1_000_000  # node pairs compared at once
CHUNK_ROWS = 40_000  # rows of complete groups searched at once
HASHES_AT_ONCE = 65_536
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a UTF-8 text over its 3-word shingles, repeats included."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(shingles), HASHES_AT_ONCE):
        part = shingles[first : first + HASHES_AT_ONCE]
        digests = np.frombuffer(b"".join(map(xxh64_digest, part, repeat(SEED))), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[key, "fp"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, fp bigint")


def materialised_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same, computed once and written, as it is read several times."""
    return materialise(fingerprints(documents, key, text), "fingerprints")


def _runs(free: int) -> list[int]:
    """The set bits of `free`, highest first, cut into one run more than may differ, each as a mask."""
    bits = [1 << i for i in range(BITS - 1, -1, -1) if free >> i & 1]
    cuts = [round(k * len(bits) / (MAX_DISTANCE + 1)) for k in range(MAX_DISTANCE + 2)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _deal(rows: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """Each row (fp, path) to one group per run of the bits its path leaves free; the masks of the new paths."""
    deeper = [mask | run for mask in masks for run in _runs(~mask & ((1 << BITS) - 1))]
    fan = MAX_DISTANCE + 1
    run = F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))
    dealt = rows.select("fp", (F.col("path") * fan).alias("path"), run.alias("run"))
    dealt = dealt.select("fp", (F.col("path") + F.col("run")).cast("int").alias("path"))
    mask = F.element_at(F.array(*[F.lit(_signed(x)).cast("long") for x in deeper]), F.col("path") + 1)
    return dealt.withColumn("key", F.col("fp").bitwiseAND(mask)), deeper


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class GrayTree:
    """Sorted fingerprints of many groups as one forest of shared bit patterns."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.order = np.lexsort((gray_rank(fp), group))
        self.group, self.fp = group[self.order], fp[self.order]
        self.forest = Forest(len(fp))
        self.starts, self.node = [], []
        new_group = np.concatenate(([True], self.group[1:] != self.group[:-1]))
        for bits in range(0, BITS + 1, STEP):
            shared = self.fp >> np.uint64(BITS - bits) if bits else np.zeros(len(fp), np.uint64)
            change = new_group | np.concatenate(([True], shared[1:] != shared[:-1]))
            self.starts.append(np.flatnonzero(change))
            self.node.append(np.cumsum(change) - 1)
        self.uniform: list[np.ndarray] = []

    def _common(self) -> None:
        """For each node the label that all its members have, or -1."""
        self.uniform = []
        for starts in self.starts:
            low = np.minimum.reduceat(self.forest.label, starts)
            self.uniform.append(np.where(low == np.maximum.reduceat(self.forest.label, starts), low, -1))

    def _children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.starts[level]
        first = self.node[level + 1][starts[nodes]]
        ends = np.concatenate((starts[1:], [len(self.fp)]))[nodes]
        return first, self.node[level + 1][ends - 1] + 1 - first

    def _one_bit_apart(self, least: int) -> None:
        """Merge members of large groups that differ in a single bit, by sorting with that bit masked."""
        sizes = np.diff(np.concatenate((self.starts[0], [len(self.fp)])))
        rows = np.flatnonzero(np.repeat(sizes, sizes) >= least)
        if not len(rows):
            return
        group, fp = self.group[rows], self.fp[rows]
        for bit in range(BITS):
            masked = fp & ~np.uint64(1 << bit)
            order = np.lexsort((masked, group))
            same = (masked[order][1:] == masked[order][:-1]) & (group[order][1:] == group[order][:-1])
            self.forest.merge(rows[order[1:][same]], rows[order[:-1][same]])

    def link(self, one_bit_from: int = 64) -> np.ndarray:
        """For each input row, the row that stands for its links within MAX_DISTANCE bits."""
        self._one_bit_apart(one_bit_from)
        self._common()
        roots = np.arange(len(self.starts[0]))
        stack = [(0, roots, roots, np.zeros(len(roots), np.int64))]
        while stack:
            level, a, b, apart = stack.pop()
            known = self.uniform[level]
            keep = (known[a] < 0) | (known[a] != known[b])
            a, b, apart = a[keep], b[keep], apart[keep]
            if not len(a):
                continue
            if level == BITS // STEP:
                self.forest.merge(self.starts[level][a], self.starts[level][b])
                self._common()
                continue
            first_a, n_a = self._children(level, a)
            first_b, n_b = self._children(level, b)
            total = n_a * n_b
            if total.sum() > CHUNK_PAIRS and len(a) > 1:
                half = len(a) // 2
                stack.append((level, a[half:], b[half:], apart[half:]))
                stack.append((level, a[:half], b[:half], apart[:half]))
                continue
            pair, place = np.repeat(np.arange(len(a)), total), _spread(total)
            x, y = first_a[pair] + place // n_b[pair], first_b[pair] + place % n_b[pair]
            level += 1
            shift = np.uint64(BITS - STEP * level)
            mask = np.uint64((1 << STEP) - 1)
            fx, fy = self.fp[self.starts[level][x]], self.fp[self.starts[level][y]]
            apart = apart[pair] + _popcount((fx ^ fy) >> shift & mask)
            keep = (apart <= MAX_DISTANCE) & ((a[pair] != b[pair]) | (x <= y))
            stack.append((level, x[keep], y[keep], apart[keep]))
        result = np.empty(len(self.fp), np.int64)
        result[self.order] = self.order[self.forest.label]
        return result


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links inside the complete groups (path, key) of a sorted frame."""
    path, key = rows["path"].to_numpy(), rows["key"].to_numpy()
    change = np.concatenate(([True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])))
    group = np.cumsum(change) - 1
    fp = rows["fp"].to_numpy().view(np.uint64) if len(rows) else np.empty(0, np.uint64)
    several = np.bincount(group)[group] > 1
    group, fp = group[several], fp[several]
    if not len(fp):
        return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
    stands = GrayTree(group, fp).link()
    linked = np.flatnonzero(stands != np.arange(len(fp)))
    return pd.DataFrame({"src": fp[linked].view(np.int64), "dst": fp[stands[linked]].view(np.int64)})


def _search_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut sorted rows into runs of complete groups and search each run."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < CHUNK_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = (rows["path"] == rows["path"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
        complete = int(np.argmax(last.to_numpy()))
        if complete:
            yield _search(rows.iloc[:complete])
        held = [rows.iloc[complete:]]
    if held:
        yield _search(pd.concat(held, ignore_index=True))


def gray_links(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(src, dst) links that connect all distinct fingerprints within MAX_DISTANCE bits as all links would."""
    rows, masks, found = distinct.select("fp", F.lit(0).alias("path")), [0], []
    for deal in range(MAX_DEALS):
        dealt, masks = _deal(rows, masks)
        if deal == MAX_DEALS - 1:
            small, rows = dealt, None
        else:
            counts = dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit)
            large = materialise(counts.select("path", "key"), "gray-large")
            if large.isEmpty():
                small, rows = dealt, None
            else:
                small = dealt.join(large, ["path", "key"], "left_anti")
                rows = materialise(dealt.join(large, ["path", "key"], "left_semi").select("fp", "path"), "gray-dense")
        grouped = small.repartition("path", "key").sortWithinPartitions("path", "key")
        found.append(grouped.select("fp", "path", "key").mapInPandas(_search_groups, "src long, dst long"))
        if rows is None:
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def gray_components(prints: DataFrame, key: str = "doc_id", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(key, fp, component_id) for each row of (key, fp); component_id is the smallest key reachable by links."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("first")), "gray-distinct")
    links = materialise(gray_links(distinct, group_limit), "gray-links")
    members = connected_components(links)
    rooted = distinct.join(members, distinct["fp"] == members["node"], "left")
    rooted = materialise(rooted.select("fp", "first", F.coalesce("component", "fp").alias("root")), "gray-rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialise(rooted.join(smallest, "root").select("fp", "component_id"), "gray-classes")
    return prints.join(classes, "fp").select(key, "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
