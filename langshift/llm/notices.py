"""License scans: exact base phrases, and fuzzy search for short notices.

A notice of a given length may hold a bounded number of edits.  Split into one more piece than edits, at least one
piece must stand in the text unchanged, so an exact multi-pattern search for all pieces finds every place where a
notice can be.  Only there the regex library's bounded-error matching verifies the whole notice and tells where it
stands and how many edits it holds.  A match starts and ends where words do, and the words that tell licences apart
(version numbers, `by`, `nc`, `nd`, `sa`) must stand in it unedited, in order, and no others of their kind: an edit may blur
a notice but not turn it into another.  Of overlapping matches the one with fewer edits counts.

Texts are compared as words: A-Z lower-cased, all other ASCII but digits and letters between words.

Defined results: a null text has no words; empty and blank texts have no matches; very long texts are searched whole;
repeated rows are scanned alike; an empty table gives an empty result; other columns, also those with names of the
result, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices in words and the labels they stand for.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
EDIT_SHARE = 12  # one edit per so many characters
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
CACHED = 10_000
ROOM = 32  # characters behind a place where a notice can be, so that the end of its last word shows
#: Words that tell licences of one family apart, beside numbers.
TELLING = frozenset(("by", "nc", "nd", "sa"))


def telling(text: str) -> list[str]:
    """The words of a text that must stand as they are."""
    return [word for word in text.split() if word in TELLING or word.isdigit()]


@dataclass(frozen=True)
class Match:
    label: str
    first_word: int
    words: int
    edits: int
    length: int


class Scanner:
    """Finds notices in normalised texts."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES):
        self.notices = notices
        self.edits = [len(text) // EDIT_SHARE for text, _ in notices]
        self.verify = [
            regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(text)}){{e<={e}}}(?!\S)") for (text, _), e in zip(notices, self.edits, strict=True)
        ]
        self.telling = [telling(text) for text, _ in notices]
        self.seen: dict[tuple[int, int, str], tuple[int, int, int] | None] = {}
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, ((text, _), edits) in enumerate(zip(notices, self.edits, strict=True)):
            cuts = [round(k * len(text) / (edits + 1)) for k in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((number, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def _verified(self, number: int, window: str, before: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice in the window, of which the first `before` characters only stand before it."""
        known = (number, before, window)
        if known not in self.seen:
            if len(self.seen) >= CACHED:
                self.seen = {}
            found = self.verify[number].search(window, before)
            if found and telling(found.group()) != self.telling[number]:
                found = None
            self.seen[known] = (*found.span(), sum(found.fuzzy_counts)) if found else None
        return self.seen[known]

    def __call__(self, text: str) -> list[Match]:
        found: list[tuple[int, int, int, int]] = []
        tried: dict[int, int] = {}
        for end, (length, places) in self.seeds.iter(text):
            for number, offset in places:
                edits, whole = self.edits[number], len(self.notices[number][0])
                start = end + 1 - length - offset
                if start == tried.get(number):
                    continue
                tried[number] = start
                low, high = max(0, start - edits), start + whole + edits
                before = min(low, 1)  # the character before tells whether a word starts
                match = self._verified(number, text[low - before : high + ROOM], before)
                if match:
                    first, last = low - before + match[0], low - before + match[1]
                    if last == len(text) or text[last] == " ":
                        found.append((match[2], first, last, number))
        return self._words(text, self._apart(found))

    def _apart(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches in text order; of those that overlap the one with fewest edits, then the longest, then the first."""
        groups: list[list[tuple[int, int, int, int]]] = []
        reach = -1
        for match in sorted(set(found), key=lambda m: m[1]):
            if match[1] >= reach:
                groups.append([])
            groups[-1].append(match)
            reach = max(reach, match[2])
        kept = []
        for group in groups:
            taken: list[tuple[int, int, int, int]] = []
            for match in sorted(group, key=lambda m: (m[0], m[1] - m[2], m[1], m[3])):
                if all(match[2] <= t[1] or match[1] >= t[2] for t in taken):
                    taken.append(match)
            kept += sorted(taken, key=lambda m: m[1])
        return kept

    def _words(self, text: str, matches: list[tuple[int, int, int, int]]) -> list[Match]:
        result, at, word = [], 0, 0
        for edits, start, end, number in matches:
            word, at = word + text.count(" ", at, start), start
            first = word + (text[start : start + 1] == " ")
            words = text[start:end].strip().count(" ") + 1
            result.append(Match(self.notices[number][1], first, words, edits, len(self.notices[number][0])))
        return result


def normalised(text: bytes | None) -> tuple[str, int]:
    """The words of a UTF-8 text joined by spaces, and their number."""
    words = (text or b"").translate(_WORDS).split()
    return b" ".join(words).decode(), len(words)


def base_places(text: str, base: tuple[tuple[str, str], ...] = BASE) -> list[tuple[int, str]]:
    """(word number, label) of every place where the words of a base phrase stand."""
    padded, places = f" {text} ", []
    for phrase, label in base:
        needle, at, word = f" {phrase} ", 0, 0
        found = padded.find(needle)
        while found >= 0:
            word, at = word + padded.count(" ", at, found), found
            places.append((word, label))
            found = padded.find(needle, found + 1)
    return places


SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("edits", T.LongType()),
    ]))),
])


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and labels of base phrases, labels and spans of notices, and a score.

    The score is 1 for an exact phrase, else the share of a notice's characters that stands unedited.
    """
    schema = T.StructType([documents.schema[key], *SCHEMA.fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = out.types[1:]
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words, n = normalised(raw)
                base, found = base_places(words), scanner(words)
                own = {label for _, label in base}
                score = 1.0 if base else max((1 - m.edits / m.length for m in found), default=0.0)
                spans = [{"label": m.label, "first_word": m.first_word, "words": m.words, "edits": m.edits} for m in found]
                row = (
                    n, len(base), min((w for w, _ in base), default=None), max((w for w, _ in base), default=None),
                    ",".join(sorted(own)), ",".join(sorted(own | {m.label for m in found})), score, spans,
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=out.names)

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, schema)
