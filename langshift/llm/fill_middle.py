"""Fill-in-the-middle transformation by an indexable skip list over the tokens of a text.

A text is cut into units (runs of ASCII letters, and every other code point alone).  The bottom lane of its skip list
holds the units; every FAN-th node of a lane also stands on the next, express lane.  A node carries two widths: how
many units and how many code points lie between it and its successor.  To cut at a unit rank the search starts on the
highest lane and goes down whenever the next step would pass the rank, adding up both widths, so the code-point
place of a cut is found exactly, in a number of steps that grows with the logarithm of the units.

Which texts are transformed, how, and where they are cut follows from a hash of the document's id alone.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stays plain; equal cuts give an
empty middle; very long texts are cut whole; repeated rows are transformed alike; a null id counts as an empty one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
FIM_PERCENT = 90  # of the texts are transformed
SPM_PERCENT = 20  # of these with the suffix first
FAN = 16


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit of the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = codes | 32
    letter = (lower >= 97) & (lower <= 122)
    inside = np.zeros(len(codes), bool)
    inside[1:] = letter[1:] & letter[:-1]
    starts = np.flatnonzero(~inside)
    return np.diff(starts, append=len(codes)).astype(np.int64)


class SkipList:
    """Lanes of nodes with their widths in units and in code points; lane 0 has a node for each unit."""

    def __init__(self, widths: np.ndarray, fan: int = FAN):
        self.fan, self.units = fan, len(widths)
        self.lanes = [(np.ones(len(widths), np.int64), widths)]
        while len(self.lanes[-1][0]) > fan:
            below = self.lanes[-1]
            heads = np.arange(0, len(below[0]), fan)
            self.lanes.append((np.add.reduceat(below[0], heads), np.add.reduceat(below[1], heads)))

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them for the rank behind the last unit."""
        node = units = points = 0
        for lane_units, lane_points in reversed(self.lanes):
            node *= self.fan
            while node < len(lane_units) and units + lane_units[node] <= rank:
                units += int(lane_units[node])
                points += int(lane_points[node])
                node += 1
        return points


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four numbers below 2 ** 32 for a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def transform(text: str, key: object, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output)."""
    first, second, share, order = draws(key, seed)
    widths = unit_widths(text)
    n = len(widths)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or share % 100 >= FIM_PERCENT:
        return n, "plain", None, None, text
    skips = SkipList(widths)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = skips.place(low), skips.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_middle(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every document."""
    schema = T.StructType([
        T.StructField(key, documents.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            rows = [transform(x or "", k, seed) for k, x in zip(batch.column(0).to_pylist(), texts, strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, arrow.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=arrow)

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    whole = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {name: F.concat(*[F.get(parts, F.lit(i)) for i in order]) for name, order in whole.items()}
    return F.when(form == "psm", joined["psm"]).when(form == "spm", joined["spm"]).otherwise(output)
