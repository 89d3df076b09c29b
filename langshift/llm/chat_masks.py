"""Chat formatting with a loss mask aligned to tokens by their offsets.

A conversation is rendered whole through one template, `<s>[INST]role[/INST]text</s>` for each turn, and encoded once
with the offsets of its tokens.  The spans of its assistant texts and the spans of its tokens are both sorted, so two
binary searches per turn find the tokens that lie under the loss.  The control strings are tokens of their own, which
no other token can reach across.

A control string inside a role or text gets a backslash behind its first character, and one that already has
backslashes there gets one more; so texts can't fake a turn, and taking one backslash away restores them exactly.

The rows of a conversation meet by ranges of turn numbers (`turns` each), so a conversation of any length is shared by
many tasks, each range being rendered and encoded as a segment; conversations of fewer turns are one segment.  Rows
stream through a task in order and a segment of very many characters is closed and continued as another piece between
two turns, so memory is bounded by one turn and `PIECE_CHARS`.

Defined results: null roles and texts are empty; a null turn comes first; rows of one turn are ordered by role and
text, and repeated rows are turns of their own; rows with a null key are one conversation; an empty text has no tokens;
very long texts are encoded whole; bytes that are no UTF-8 become U+FFFD; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from langshift.operators.storage import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  # a public vocabulary; any file of the tokenizers library will do
LEARNED = "assistant"  # the role whose texts are under the loss
TURNS = 1024  # turn numbers that one segment covers
PIECE_CHARS = 4_000_000
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
_ESCAPE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|\|endoftext\|>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|\|endoftext\|>)")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted (role, text) turns, and the spans of the learned texts in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        start = at + len(head)
        if role == LEARNED:
            spans.append((start, start + len(body)))
        parts += (head, body, "</s>")
        at = start + len(body) + len("</s>")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that `render` was given."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, given by ascending starts and ends, overlap one of the ascending spans."""
    mask = np.zeros(len(starts), bool)
    bounds = np.array(spans, np.int64).reshape(-1, 2)
    first, last = np.searchsorted(ends, bounds[:, 0], "right"), np.searchsorted(starts, bounds[:, 1], "left")
    for a, b in zip(first, last, strict=True):
        mask[a:b] = True
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped text of every run of masked tokens."""
    at = np.flatnonzero(mask)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    return [unescape(formatted[starts[run[0]] : ends[run[-1]]]) for run in runs]


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
    return tokenizer


def _plain(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def chat_segments(
    rows: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    turns: int = TURNS,
) -> DataFrame:
    """(key, segment, piece, formatted, tokens, starts, ends, loss): rendered and encoded conversations.

    starts and ends are the tokens' offsets in `formatted`, in code points; loss tells which tokens are learned from.
    The pieces of a segment are neighbours in one partition, in order.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("segment", T.LongType()), T.StructField("piece", T.IntegerType()),
        T.StructField("formatted", T.StringType()), T.StructField("tokens", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("loss", T.ArrayType(T.BooleanType())),
    ])
    arrow = to_arrow_schema(schema)

    def encoded(pieces: list[tuple[tuple, int, list[tuple[str, str]]]]) -> pa.RecordBatch:
        tokenizer, columns = _tokenizer(shared.value), [[] for _ in arrow]
        rendered = [render(turns) for _, _, turns in pieces]
        for (place, piece, _), (formatted, spans) in zip(pieces, rendered, strict=True):
            encoding = tokenizer.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoding.offsets, np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            row = (*place, piece, formatted, encoding.ids, starts, ends, loss_mask(starts, ends, spans))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, piece, turns, size, ready, held = None, 0, [], 0, [], 0
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for at, who, said in zip(names, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if turns and (at != place or size > PIECE_CHARS):
                    ready.append((place, piece, turns))
                    held += size
                    piece, turns, size = piece + 1 if at == place else 0, [], 0
                    if held > PIECE_CHARS:
                        yield encoded(ready)
                        ready, held = [], 0
                place = at
                turns.append((_plain(who), _plain(said)))
                size += len(turns[-1][0]) + len(turns[-1][1])
        if turns:
            ready.append((place, piece, turns))
        if ready:
            yield encoded(ready)

    named = rows.select(
        F.col(key).alias("_key"), F.floor(F.col(turn) / turns).cast("long").alias("_segment"),
        F.col(role).cast("binary").alias("_role"), F.col(text).cast("binary").alias("_text"), F.col(turn).alias("_turn"),
    )
    met = named.repartition("_key", "_segment").sortWithinPartitions("_key", "_segment", "_turn", "_role", "_text")
    return met.select("_key", "_segment", "_role", "_text").mapInArrow(run, schema)


def read_back(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted output and its mask.

    The segments of a conversation must be neighbours in one partition, in order; they stream through.
    """
    schema = T.StructType([
        T.StructField(key, segments.schema[key].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, open_ = [], None
        for batch in batches:
            names, formatted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = [batch.column(c) for c in (2, 3, 4)]
            for i, name in enumerate(names):
                if open_ is None or open_[0] != name:
                    if open_:
                        done.append((open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]))
                    open_ = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted[i]):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{text}\n".encode())
                starts, ends, mask = (x[i].values.to_numpy(zero_copy_only=False) for x in lists)
                for text in masked_texts(formatted[i], starts, ends, mask):
                    open_[3] += len(text)
                    open_[4].update(text.encode())
                open_[5] += len(formatted[i])
            if len(done) >= 4096:
                yield table(done)
                done = []
        if open_:
            done.append((open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5]))
        if done:
            yield table(done)

    return segments.select(key, "formatted", "starts", "ends", "loss").mapInArrow(run, schema)


def digests(rows: DataFrame, key: str = "conv_id", turn: str = "turn", turns: int = TURNS, **options) -> DataFrame:
    """`read_back` of all formatted conversations.

    Without a conversation of several segments, which one pass over the keys shows, formatting and reading need one
    shuffle; else the segments are written and those of a conversation are put in order first, as a digest needs them.
    """
    segments = chat_segments(rows, key, turn, turns=turns, **options)
    segment = F.floor(F.col(turn) / turns)
    ranges = rows.groupBy(key).agg(F.count_distinct(F.coalesce(segment.cast("string"), F.lit(""))).alias("_segments"))
    if not ranges.where("_segments > 1").isEmpty():
        written = materialise(segments, "chat-segments")
        segments = written.repartition(key).sortWithinPartitions(key, "segment", "piece")
    return read_back(segments, key)
