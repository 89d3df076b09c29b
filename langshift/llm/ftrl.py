"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of a text's words, neighbouring pairs and pairs that skip one or two words.  Each
coordinate has its own learning rate, and the L1 term keeps all weights at zero that the labels do not call for, so
the model that is broadcast has at most `2 ** BITS` weights and in practice a few thousand.

Training reads a bounded sample: at most `sample` labelled documents, those with the smallest hash of their id, dealt
to a fixed number of folds by another hash.  In each round every fold runs through its documents in hash order from
the common state; the accumulators are then averaged and the next round starts from them.  The result does not depend
on partitioning, and no task holds more than its fold.  All other work, scoring included, covers all rows and texts.

Defined results: a null or empty text scores the model's bias alone; of repeated labels for an id the largest counts,
null labels and labels of unknown ids are left out; of repeated ids the smallest text is learned from and every row is
scored; without any label the score is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from langshift.operators.storage import materialise

BITS = 20
SAMPLE = 24_000  # labelled documents that training reads at most
FOLDS = 4
ROUNDS = 3
EPOCHS = 2  # passes over a fold in a round
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.0
THRESHOLD = 0.7
CACHED_WORDS = 500_000
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class Features:
    """Hashed features of texts; remembers the hashes of words it has seen."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Feature numbers of a UTF-8 text, with repeats."""
        words = (text or b"").translate(_ASCII).split()
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = xxh64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        parts = [h * np.uint64(_MIX[0])]
        for gap in (1, 2, 3):
            first, second = h[:-gap], h[gap:]
            parts.append((first * np.uint64(_MIX[gap]) + second) * np.uint64(_MIX[0]))
        return (np.concatenate(parts) >> self.shift).astype(np.int64)


@dataclass
class State:
    """FTRL accumulators; the last coordinate is the bias, which is not penalised."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, size: int) -> State:
        return cls(np.zeros(size + 1), np.zeros(size + 1))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        pull = np.where(np.arange(len(self.z))[at] == len(self.z) - 1, 0.0, L1)
        return -np.sign(z) * np.maximum(np.abs(z) - pull, 0) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum()))))
        g = p - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def _learn_fold(rows: pd.DataFrame, start: tuple[np.ndarray, ...], bits: int) -> pd.DataFrame:
    """EPOCHS passes over a fold from the common state; returns the coordinates that it has ever changed."""
    state, features = State.empty(1 << bits), Features(bits)
    at, state.z[at], state.n[at] = start
    texts = [np.unique(features(text)).astype(np.int32) for text in rows["text"]]
    for _ in range(EPOCHS):
        for found, label in zip(texts, rows["label"], strict=True):
            state.learn(found, label)
    at = np.flatnonzero(state.n)
    return pd.DataFrame({"at": at.astype(np.int32), "z": state.z[at].astype(np.float32), "n": state.n[at].astype(np.float32)})


def _fold_learner(start: Broadcast, bits: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda fold: _learn_fold(fold.sort_values("place"), start.value, bits)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample: int, key: str, text: str) -> DataFrame:
    """(fold, place, label, text) of at most `sample` labelled documents; the ids drawn are the bounded side."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("label"))
    ids = documents.select(F.col(key).alias("_key")).distinct()
    known = known.join(ids, "_key", "left_semi")
    drawn = known.withColumn("place", F.xxhash64("_key")).orderBy("place", "_key").limit(sample)
    drawn = F.broadcast(materialise(drawn, "ftrl-drawn"))
    texts = documents.select(F.col(key).alias("_key"), F.encode(text, "UTF-8").alias("text"))
    rows = texts.join(drawn, "_key").groupBy("_key", "place", "label").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("place", F.lit(7)), F.lit(FOLDS)).cast("int")
    return rows.select(fold.alias("fold"), "place", F.col("label").cast("int").alias("label"), "text")


@dataclass(frozen=True)
class Model:
    """Non-zero weights by feature number."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS


def train(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    bits: int = BITS,
    key: str = "doc_id",
    text: str = "text",
) -> Model:
    rows = materialise(labelled_sample(documents, labels, label, sample, key, text), "ftrl-sample")
    spark = documents.sparkSession
    folds = max(1, rows.select("fold").distinct().count())
    start = (np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.float32))
    for _ in range(rounds):
        learn = _fold_learner(spark.sparkContext.broadcast(start), bits)
        learned = rows.groupBy("fold").applyInPandas(learn, "at int, z float, n float")
        mean = learned.groupBy("at").agg(*[(F.sum(c) / folds).cast("float").alias(c) for c in ("z", "n")])
        found = mean.toArrow()  # at most 2 ** bits + 1 rows of twelve bytes
        start = tuple(found[c].to_numpy() for c in ("at", "z", "n"))
    full = State.empty(1 << bits)
    at, full.z[at], full.n[at] = start
    weight = full.weights(slice(None))
    at = np.flatnonzero(weight[:-1])
    return Model(at, weight[at].astype(np.float32), float(weight[-1]), bits)


def _scorer(shared: Broadcast) -> Callable[[list[bytes | None]], np.ndarray]:
    at, values, bias, bits = shared.value
    features, weight = Features(bits), np.zeros(1 << bits, np.float32)
    weight[at] = values

    def scores(texts: list[bytes | None]) -> np.ndarray:
        sums = []
        for text in texts:
            found = features(text)
            sums.append(weight[np.unique(found[weight[found] != 0])].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64) + bias, -35, 35)))

    return scores


def _shared(documents: DataFrame, model: Model) -> Broadcast:
    return documents.sparkSession.sparkContext.broadcast((model.at, model.weight, model.bias, model.bits))


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row, from its whole text."""
    shared = _shared(documents, model)
    schema = T.StructType([documents.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared)
        for batch in batches:
            found = scores(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=schema.names)

    return documents.select(key, text).mapInArrow(run, schema)


def below(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, unchanged, whose score is less than the threshold."""
    shared, place = _shared(documents, model), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place).cast(pa.binary()).to_pylist()) < threshold))

    return documents.mapInArrow(run, documents.schema)


def held_out(key: Column) -> Column:
    """Ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
