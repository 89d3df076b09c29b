import random

import corpus_pipeline
import numpy as np
import pytest

from langshift.llm.near_copies import Families, leading, linked, near_copies, shingle_set, sifted, sketch
from langshift.llm.simhash_gray import fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def planted():
    """Bases of 20 to 120 words with copies of one to six edited words, a line that many share, exact copies."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    line = [word() for _ in range(9)]
    texts = [None, "", " ", "one", "ONE", "two words"]
    for family in range(30):
        base = [word() for _ in range(draw.randint(20, 120))]
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy + line * (family % 2)))
    texts += [" ".join([*line, word()]) for _ in range(20)] + texts[10:14]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_components_equal_brute_force(spark, block):
    texts = planted()
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in near_copies(frame, "id", block=block).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_stage_catches_one_edited_word_that_fingerprints_miss(spark):
    draw = random.Random(4)
    rows = []
    for i in range(40):
        words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(100)]
        rows.append((2 * i, " ".join(words)))
        words[50] = "edited"
        rows.append((2 * i + 1, " ".join(words)))
    apart = [(fingerprint(a[1].encode()) ^ fingerprint(b[1].encode())).bit_count() for a, b in zip(rows[::2], rows[1::2])]
    assert max(apart) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * i for i in range(40)]


def test_odd_rows(spark, no_docs):
    assert near_copies(no_docs, "doc_id").count() == 0
    named = spark.createDataFrame([("b", "x y"), ("a", "X  Y"), ("c", None), ("d", " ")], "id string, text string")
    assert {r["id"]: r["component_id"] for r in near_copies(named, "id").collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_sketches_never_hide_a_similar_pair():
    texts = [t.encode() for t in planted() if t]
    sets = [shingle_set(t) for t in texts]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sizes, names = np.array([len(s) for s in sets]), list(range(len(sets)))
    alive = sifted(sizes, [sketch(s) for s in sets], names)
    similar = [any(i != j and jaccard(a, b) >= 0.8 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert all(alive[i] for i in names if similar[i]) and alive.sum() < len(sets)
    assert not sifted(sizes, [sketch(s) for s in sets], [0] * len(sets)).any()  # all are settled together
    apart = [(sizes[i] + sizes[j] - 2 * len(np.intersect1d(sets[i], sets[j])), i, j) for i in names for j in range(i)]
    for differing, i, j in apart[::7]:
        least = min(len(sketch(sets[i])), len(sketch(sets[j])))
        folded = [np.bitwise_xor.reduce(np.frombuffer(sketch(s), np.uint8).reshape(-1, least), axis=0) for s in (sets[i], sets[j])]
        assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= differing


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_families_hold_every_pair_of_like_size(batch):
    draw = random.Random(3)
    rows = sorted({(draw.randrange(6), draw.choice((1, 2, 5, 6, 7, 9, 11, 14, 18)), draw.randrange(1000)) for _ in range(120)})
    families, found = Families(), set()
    for at in range(0, len(rows), batch):
        part = np.array(rows[at : at + batch])
        found |= {(int(a), int(b)) for a, b in zip(*families(part[:, 0], part[:, 1], part[:, 2]))}
    members = {}
    for family, name in found:
        members.setdefault(family, {family}).add(name)
    for shingle, n, name in rows:
        for other_shingle, m, other in rows:
            if shingle == other_shingle and name != other and 0.8 <= n / m <= 1.25:
                assert any({name, other} <= group for group in members.values())


def test_forests_use_known_roots():
    base = np.arange(100, dtype=np.uint64)
    sets = [base, base + 5, base + 10, base + 1000, base + 1003]
    assert sorted(linked(sets, [0, 1, 2, 3, 4])) != []
    assert linked(sets, [0, 0, 0, 3, 3]) == []
    assert len(linked(sets, [0, 1, 0, 3, 4])) == 2


def test_very_long_and_repeated_texts(spark):
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(60_000)]
    near = [*words[:30_000], "edited", *words[30_001:]]
    rows = [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(words)), (3, " ".join(words[:40_000])), (4, None), (5, "\t")]
    got = {r["id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
