import math
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from langshift.llm.ftrl import ALPHA, BETA, EPOCHS, FOLDS, L1, L2, ROUNDS, Features, State, below, held_out, score, train


def labelled(spark, n=600):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = draw.choices(words, k=draw.randint(20, 60))
        if i % 4 == 0:
            text[3:3] = draw.sample(["idiotic", "moronic", "scummy"], 2)
        docs.append((i, " ".join(text), 1))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, label int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_held_out_labels(spark):
    docs, labels = labelled(spark)
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), "toxic")
    assert 0 < len(model.at) < 2000
    rows = score(docs, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    bad = [r["score"] for r in rows if r["held"] and r["doc_id"] % 4 == 0]
    good = [r["score"] for r in rows if r["held"] and r["doc_id"] % 4]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    kept = {r["doc_id"] for r in below(docs, model, 0.5).collect()}
    assert kept == {r["doc_id"] for r in rows if r["score"] < 0.5}
    again = {r["doc_id"]: r["score"] for r in score(docs.repartition(7), train(docs.repartition(5), labels.where(~held_out(F.col("doc_id"))), "toxic")).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-5 for r in rows)


def test_sample_bound_is_a_parameter(spark):
    docs, labels = labelled(spark, 60)
    model = train(docs, labels, "toxic", sample=10, rounds=1)
    assert score(docs, model).count() == 60


def test_odd_rows(spark, odd_docs, no_docs, odd_rows):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (999, 1), (41, 0), (6, 0)], "doc_id long, toxic int")
    model = train(odd_docs, labels, "toxic")
    rows = score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in score(odd_docs.where("trim(text) = '' or text is null"), model).collect()}
    assert len(blank) == 1
    assert below(odd_docs, model).schema == odd_docs.schema
    unlabelled = train(odd_docs, labels.where("false"), "toxic")
    assert {r["score"] for r in score(odd_docs, unlabelled).collect()} == {0.5}
    assert score(no_docs, train(no_docs, labels, "toxic")).count() == 0


def test_features_are_ngrams_and_skipgrams():
    seen = Features()
    assert len(seen(b"")) == 0 and len(seen(None)) == 0
    assert len(seen(b"a b c d")) == 4 + 3 + 2 + 1
    assert set(seen(b"A,b")) == set(seen(b"a b"))


def test_rare_features_keep_zero_weights():
    state = State.empty(10)
    for _ in range(3):
        state.learn(np.array([2]), 1)
    assert state.weights(np.array([2, 3])).tolist()[1] == 0
    for _ in range(50):
        state.learn(np.array([2]), 1)
        state.learn(np.array([4]), 0)
    assert state.weights(np.array([2]))[0] > 0 > state.weights(np.array([4]))[0]


def plain_features(text, bits):
    """Distinct hashes of words, neighbours and pairs that skip one or two words, in whole numbers."""
    mixers = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
    words = [xxh64_intdigest(w.encode()) for w in re.split("[\\x00-/:-@\\[-`{-\\x7f]+", (text or "").lower()) if w]
    sums = list(words)
    for gap in (1, 2, 3):
        sums += [words[i] * mixers[gap] + words[i + gap] for i in range(len(words) - gap)]
    return sorted({(s * mixers[0]) % 2**64 >> (64 - bits) for s in sums})


def plain_weight(z, n, pull):
    return 0.0 if abs(z) <= pull else -(z - math.copysign(pull, z)) / ((BETA + math.sqrt(n)) / ALPHA + L2)


def plain_train(folds, bits):
    """(weights by feature, bias): every fold from the common state in every round, then means over the folds."""
    bias = 1 << bits
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(ROUNDS):
        total_z, total_n = defaultdict(float), defaultdict(float)
        for rows in folds:
            own_z, own_n = defaultdict(float, z), defaultdict(float, n)
            for found, label in rows * EPOCHS:
                at = [*found, bias]
                w = {i: plain_weight(own_z[i], own_n[i], 0.0 if i == bias else L1) for i in at}
                g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
                for i in at:
                    before = own_n[i]
                    own_n[i] = before + g * g
                    own_z[i] += g - (math.sqrt(own_n[i]) - math.sqrt(before)) / ALPHA * w[i]
            for i in own_n:
                total_z[i] += own_z[i] / len(folds)
                total_n[i] += own_n[i] / len(folds)
        z, n = total_z, total_n
    return {i: w for i in n if (w := plain_weight(z[i], n[i], 0.0 if i == bias else L1)) and i != bias}, plain_weight(z[bias], n[bias], 0.0)


def test_training_and_scores_against_plain_numbers(spark):
    docs, labels = labelled(spark, 320)
    bits = 12
    place = F.xxhash64("doc_id")
    rows = docs.join(labels, "doc_id").select("text", "toxic", place.alias("place"), F.pmod(F.xxhash64(place, F.lit(7)), F.lit(FOLDS)).alias("fold"))
    folds = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r["place"]):
        folds[r["fold"]].append((plain_features(r["text"], bits), r["toxic"]))
    weights, bias = plain_train(list(folds.values()), bits)
    model = train(docs, labels, "toxic", bits=bits)
    got = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
    assert len(folds) == FOLDS and len(weights) > 3 and abs(model.bias - bias) < 1e-5
    assert all(abs(got.get(i, 0.0) - weights.get(i, 0.0)) < 1e-5 for i in got.keys() | weights.keys())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in score(docs, model).collect():
        reach = bias + sum(weights.get(i, 0.0) for i in plain_features(texts[r["doc_id"]], bits))
        assert abs(r["score"] - 1 / (1 + math.exp(-reach))) < 1e-5
