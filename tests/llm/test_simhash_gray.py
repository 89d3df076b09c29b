import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from langshift.llm import simhash_gray
from langshift.llm.simhash_gray import GrayTree, fingerprint, fingerprints, gray_components, gray_rank


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(key, fp) to smallest key reachable by fingerprints at most three bits apart."""
    result, prints = {}, {}
    for key, fp in rows:
        if key is not None or fp not in prints:
            prints[fp] = key if prints.get(fp) is None else prints[fp] if key is None else min(key, prints[fp])
    todo = set(prints)
    while todo:
        group, stack = set(), [todo.pop()]
        while stack:
            fp = stack.pop()
            group.add(fp)
            near = {x for x in todo if (x ^ fp).bit_count() <= 3}
            todo -= near
            stack += near
        first = min((prints[x] for x in group if prints[x] is not None), default=None)
        result |= dict.fromkeys(group, first)
    return Counter((key, fp, result[fp]) for key, fp in rows)


def test_fingerprints_equal_brute_force(odd_docs, odd_rows):
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in fingerprints(odd_docs).collect())
    assert got == Counter((r[0], brute_print(r[1])) for r in odd_rows)
    assert fingerprint(b"\xc2\xa0") != 0  # only ASCII white space separates


def near_prints(draw, families=20, size=30):
    prints = []
    for _ in range(families):
        base = draw.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            prints.append(x)
    return prints + [0, 1, 2**64 - 1] + [draw.getrandbits(64) for _ in range(200)]


def test_gray_rank_orders_one_bit_steps():
    codes = np.arange(256, dtype=np.uint64)
    walk = codes[np.argsort(gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(walk, walk[1:]))


@pytest.mark.parametrize("one_bit_from", [2, 10**9])
def test_tree_links_as_brute_force(one_bit_from):
    prints = sorted(set(near_prints(random.Random(1))))
    stands = GrayTree(np.zeros(len(prints), np.int64), np.array(prints, np.uint64)).link(one_bit_from)
    expected = brute_components(list(enumerate(prints)))
    assert Counter((i, prints[i], int(stands[i])) for i in range(len(prints))).keys() >= set()
    groups = {}
    for (_, fp, first), _n in expected.items():
        groups.setdefault(first, set()).add(fp)
    mine = {}
    for i, s in enumerate(stands):
        mine.setdefault(int(s), set()).add(prints[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("limit", [2048, 8])
def test_components_equal_brute_force(spark, limit):
    draw = random.Random(2)
    rows = [(i, x) for i, x in enumerate(near_prints(draw))] + [(10_000 + i, 7) for i in range(300)] + [(None, 12345), (3, 999)]
    signed = [(k, x - 2**64 if x >> 63 else x) for k, x in rows]
    frame = spark.createDataFrame(signed, "doc_id long, fp long").repartition(5)
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in gray_components(frame, group_limit=limit).collect())
    assert got == brute_components(rows)


def test_odd_rows(odd_docs, no_docs, odd_rows):
    got = gray_components(simhash_gray.materialised_fingerprints(odd_docs)).collect()
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == brute_components([(r[0], brute_print(r[1])) for r in odd_rows])
    assert gray_components(simhash_gray.materialised_fingerprints(no_docs)).count() == 0
