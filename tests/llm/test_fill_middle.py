import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from langshift.llm.fill_middle import SkipList, draws, fill_middle, restored, transform, unit_widths

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


@given(st.text(alphabet="abZ é\n<PSM>🤦1", max_size=80), st.integers(2, 5))
def test_every_rank_is_reached_exactly(text, fan):
    units = UNIT.findall(text)
    assert unit_widths(text).tolist() == [len(u) for u in units]
    skips = SkipList(unit_widths(text), fan)
    assert [skips.place(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]


def test_lanes_carry_both_widths_and_steps_stay_few():
    draw = random.Random(1)
    text = "".join(draw.choice("ab ü7") for _ in range(200_000))
    skips = SkipList(unit_widths(text))
    for units, points in skips.lanes:
        assert units.sum() == skips.units and points.sum() == len(text)
    assert len(skips.lanes[-1][0]) <= skips.fan


def plainly(text, key):
    """The contract, restated over a list of units."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_all_documents_equal_brute_force_and_are_restored(spark, odd_docs, odd_rows):
    more = [(1000 + i, t, "en", "s", 1, 1, "x", 7, 5, "y") for i, t in enumerate(["a<P>b", "<S>", "x<M", "S>", "<<P", "\x00é", "a|b\\c", "<P"] * 5)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    made = fill_middle(docs).withColumn("whole", restored(F.col("output"), F.col("form"))).collect()
    rows = [*odd_rows, *more]
    want = sorted(((r[0], *plainly(r[1], r[0]), r[1] or "") for r in rows), key=repr)
    assert sorted((tuple(r) for r in made), key=repr) == want
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_cut_parts_that_look_like_a_sentinel(spark):
    """A cut may leave `<` before a sentinel; the parts still come apart as they were."""
    rows = [(i, "<" * 9 + "P" + "<" * 5) for i in range(200)]
    made = fill_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    back = made.select(restored(F.col("output"), F.col("form")).alias("whole")).distinct().collect()
    assert [r["whole"] for r in back] == [rows[0][1]]


def test_draws_and_plain_transform():
    assert transform("", 1)[1] == "plain" and transform("a<M>", 1)[1] == "plain"
    assert all(0 <= x < 2**32 for x in draws(17))
    assert draws(None) == [int(hashlib.sha256(b"1:").hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]


def test_empty(no_docs):
    assert fill_middle(no_docs).count() == 0
