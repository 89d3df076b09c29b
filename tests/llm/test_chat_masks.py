import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from langshift.llm.chat_masks import CONTROL, chat_segments, digests, escape, loss_mask, masked_texts, parse, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string, segment int, _key string, formatted string, loss int"
PIECES = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|endoftext|>", "é", "🤦", "\n", " ", "word", *CONTROL]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escapes_are_reversible_and_hide_control_strings(text):
    hidden = escape(text)
    assert unescape(hidden) == text
    assert not any(c in hidden for c in CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "[INST]"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=5))
def test_rendered_turns_are_read_back(turns):
    formatted, spans = render(turns)
    assert parse(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [text for role, text in turns if role == "assistant"]


def test_mask_equals_the_overlap_of_every_pair():
    draw = random.Random(2)
    for _ in range(200):
        cuts = sorted(draw.sample(range(60), draw.randint(2, 20)))
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        bounds = sorted(draw.sample(range(60), 6))
        spans = [(bounds[0], bounds[1]), (bounds[2], bounds[3]), (bounds[4], bounds[4])]
        want = [any(max(s, a) < min(e, b) for a, b in spans[:2]) or any(s < a < e for a, _ in spans[2:]) for s, e in zip(starts, ends)]
        assert loss_mask(starts, ends, spans).tolist() == want


def conversations():
    draw = random.Random(5)
    words = ["plain", "wörld", "🤦🏼", "</s>", "<s", "[INST]", "[\\INST]", "<|endoftext|>", "  ", "\n", "x" * 50]
    said = lambda: None if draw.random() < 0.1 else " ".join(draw.choices(words, k=draw.randint(0, 12)))
    rows = [(c, t, ("system", "user", "assistant", None)[draw.randrange(4)], said()) for c in range(12) for t in range(draw.randint(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], said()) for t in range(300)]  # one conversation holds most rows
    rows += [(None, 1, "assistant", "no id"), (None, 0, "user", ""), (60, None, "assistant", "no turn"), (60, 0, "assistant", None)]
    rows += [(61, 3, "assistant", "again")] * 3 + [(61, 3, "user", "tie"), (62, 0, "assistant", "long " * 40_000), (63, -5, "assistant", "x")]
    return [(*r, 1, "clash", "clash", 2) for r in rows]


def expected(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    result = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        learned = "".join(text for role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        formatted = "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)
        result[conv] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned), len(formatted))
    return result


@pytest.mark.parametrize("turns", [1024, 7])
def test_digests_equal_brute_force(spark, turns):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = digests(frame, turns=turns).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected(rows) and len(got) == len(expected(rows))


def test_tokens_tile_the_output_and_masks_cover_the_learned_texts(spark):
    rows = conversations()
    segments = chat_segments(spark.createDataFrame(rows, SCHEMA), turns=7).collect()
    for r in segments:
        starts, ends = np.array(r["starts"]), np.array(r["ends"])
        covered = np.zeros(len(r["formatted"]), bool)
        for a, b in zip(starts, ends):
            covered[a:b] = True
        assert covered.all() and len(r["tokens"]) == len(starts) == len(r["loss"])
        learned = [text for role, text in parse(r["formatted"]) if role == "assistant" and text]
        assert masked_texts(r["formatted"], starts, ends, np.array(r["loss"])) == learned
    assert sum(r["conv_id"] == 50 for r in segments) == -(-300 // 7)


def test_long_segments_are_cut_between_turns(spark, monkeypatch):
    monkeypatch.setattr("langshift.llm.chat_masks.PIECE_CHARS", 500)
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    pieces = chat_segments(frame).where("conv_id = 50").select("piece", F.length("formatted").alias("n")).collect()
    assert sorted(r["piece"] for r in pieces) == list(range(len(pieces))) and len(pieces) > 5
    assert {r[0]: tuple(r[1:]) for r in digests(frame).collect()} == expected(rows)


def test_empty(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).count() == 0
