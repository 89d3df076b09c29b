import random
import re
from collections import Counter

import regex

from langshift.llm.notices import BASE, EDIT_SHARE, NOTICES, Scanner, base_places, normalised, scan, telling

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = re.findall(PATTERN, lowered(text))
    places = []
    for phrase, label in BASE:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return words, places


def test_base_places_equal_brute_force():
    draw = random.Random(8)
    for _ in range(200):
        text = " ".join(draw.choices(["CC", "by", "cc", "general", "Public", "license,", "all", "RIGHTS", "reserved.", "é", "x-y"], k=40))
        words, expected = brute_base(text)
        got, n = normalised(text.encode())
        assert got.split(" ") == words and n == len(words)
        assert sorted(base_places(got)) == sorted(expected)


def allowed(text):
    """Notices that stand in the text between words, within their edits, with all telling words as they are."""
    found = []
    for notice, _ in NOTICES:
        match = regex.search(rf"(?b)(?<!\S)(?:{notice}){{e<={len(notice) // EDIT_SHARE}}}(?!\S)", text)
        if match and telling(match.group()) == telling(notice):
            found.append(notice)
    return found


def test_other_licences_are_not_taken_for_a_notice():
    scanner = Scanner()
    for text in (
        "licensed under cc by 3 0", "licensed under cc by sa 3 0", "licensed under the gnu general public license version 1",
        "licensed under the apache license version 1 1", "licensed under cc by nd 4 0", "sublicensed under cc by 4 0",
        "licensed under cc by 4 05", "licensed under cc by nc sa 4 0",
    ):
        for around in (text, f"some {text} words", f"it is {text}"):
            assert scanner(around) == [], around
    for text, label in (("lisensed under cc by 4 0", "cc-by-4.0"), ("licensed undr cc by nc 4 0", "cc-by-nc-4.0"), ("licensed under the gnu genral publc license version 3", "gpl-3.0")):
        assert [m.label for m in scanner(f"a {text} b")] == [label]


def test_edited_notices_are_found():
    draw, scanner = random.Random(9), Scanner()
    for text, label in NOTICES:
        for edits in range(len(text) // EDIT_SHARE + 1):
            letters = list(text)
            for place in draw.sample(range(1, len(letters) - 1), edits):
                letters[place] = draw.choice(("", letters[place] + "q", "z")) if letters[place] != " " else " "
            around = f"some words here {''.join(letters)} and there"
            exact = allowed(around)
            found = scanner(around)
            assert bool(found) == bool(exact), (text, around)
            if not found:
                continue
            assert found[0].edits <= edits and found[0].label in {n for t, n in NOTICES if t in exact}
            if not edits:
                assert found[0].label == label and found[0].first_word == 3 and found[0].words == text.count(" ") + 1


def test_seeds_lose_nothing():
    """Every window that bounded-error matching accepts is also found from the seeds."""
    draw, scanner = random.Random(10), Scanner()
    for _ in range(60):
        text, _ = draw.choice(NOTICES)
        letters = list(text)
        for _ in range(draw.randint(0, 8)):
            letters[draw.randrange(len(letters))] = draw.choice("abz ")
        around = " ".join(f"lorem {''.join(letters)} ipsum".split())
        assert bool(scanner(around)) == bool(allowed(around))


def test_clean_text_is_left_alone():
    assert Scanner()("a license to drive is not a software license at all my rights are reserved seats") == []


def test_scan(spark, odd_docs, no_docs, odd_rows):
    rows = scan(odd_docs).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in rows) == Counter((r[0], len(brute_base(r[1])[0])) for r in odd_rows)
    assert scan(no_docs).count() == 0
    text = "Licensed under CC BY-NC 4.0.\nAll rights reserved. " + "pad " * 50_000 + "relased under the MIT licence"
    row = scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0]["n_base"], row[0]["first_word"], row[0]["last_word"]) == (2, 2, 7)
    assert (row[0]["base_labels"], row[0]["labels"]) == ("cc-by,reserved", "cc-by,cc-by-nc-4.0,mit,reserved")
    assert row[0]["spans"][1]["first_word"] == 50_010 and row[0]["spans"][1]["edits"] == 2
    assert (row[1]["n_words"], row[1]["labels"], row[1]["score"], row[1]["first_word"]) == (0, "", 0.0, None)
