import contextlib
import io
import random
import re
from collections import Counter
from urllib.parse import quote

from pyspark.sql import functions as F

from langshift.llm.bloom_cascade import RULES, Cascade, distinct_keys, host_and_path, judge_urls, mark_listed, parts_within

ODD = [
    "https://a.example.net/en/1?q=1", "http://EXAMPLE.com/de/x#y", "http://example.com", "ftp://x.org/fr/", "http://x.org/fr", None, "",
    "no scheme/en/", "http://", "http:///de/", "https://net/", "https://net", "https://notexample.net/en/", "a://b://c.net/x",
    "https://example.net/en/" + "long/" * 5000, "https://É.Org/fr/ü", "x\n://y.net/\nz?q",
]


def brute(url):
    found = (url or "").find("://")
    if found < 0:
        host = path = ""
    else:
        rest = url[found + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [
        (len(rule), rule, says) for rule, says in RULES
        if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_cascade_is_exact(spark, tmp_path):
    draw = random.Random(1)
    keys = [quote("".join(draw.choices("abcdefghij", k=9))) for _ in range(3000)]
    listed = set(draw.sample(keys, 400)) | {keys[0]}
    rows = [(k, k in listed) for k in keys] * 2
    universe = spark.createDataFrame(rows, "key string, listed boolean").repartition(4)
    assert len(Cascade(distinct_keys(universe)).levels) >= 2
    spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(f"{tmp_path}/keys")
    got = mark_listed(spark.read.parquet(f"{tmp_path}/keys"), universe, "key", "hit")
    assert {r["key"]: r["hit"] for r in got.collect()} == {k: k in listed for k in keys}
    assert_native(got)


def assert_native(frame):
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        frame.explain("formatted")
    operators = set(re.findall(r"^\(\d+\) (\w+)", plan.getvalue(), re.M))
    assert operators and not any(re.search("Join|Python|Pandas|Arrow|Exchange", name) for name in operators)


def test_beyond_the_size_bound_parts_answer(spark, monkeypatch):
    rows = [(f"k{i % 300}", i % 300 % 3 == 0, i) for i in range(900)] + [(None, False, 1)]
    universe = spark.createDataFrame([r[:2] for r in rows], "key string, listed boolean")
    built = []
    monkeypatch.setattr(Cascade, "__init__", _counting(Cascade.__init__, built))
    frame = spark.createDataFrame(rows, "key string, old boolean, _part int")
    got = mark_listed(frame, universe, "key", "hit", limit_bytes=32)
    assert len(built) == parts_within(distinct_keys(universe), 32) > 3
    assert_native(got)
    assert all(8 * 32 >= sum(level.bits for level in cascade.levels) - 64 * len(cascade.levels) for cascade in built)
    assert Counter(tuple(r) for r in got.collect()) == Counter((*r, r[1]) for r in rows)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    wanted = judge_urls(pages, F.col("key").isin("example.com", "")).collect()
    assert Counter(judge_urls(pages, F.col("key").isin("example.com", ""), limit_bytes=1).collect()) == Counter(wanted)


def _counting(build, built):
    def init(self, keys):
        build(self, keys)
        built.append(self)

    return init


def test_nothing_or_everything_listed(spark):
    for answer in (False, True):
        rows = spark.createDataFrame([(f"k{i}", answer) for i in range(100)], "key string, listed boolean")
        assert {r["hit"] for r in mark_listed(rows, rows, "key", "hit").collect()} == {answer}
    empty = spark.createDataFrame([], "key string, listed boolean")
    assert mark_listed(empty, empty, "key", "hit").count() == 0


def test_urls(spark):
    rows = [(i, url, "x", True) for i, url in enumerate(ODD)] + [(3, ODD[0], "x", True), (None, ODD[1], "x", True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, listed boolean")
    got = Counter(tuple(r) for r in judge_urls(pages, F.col("key").isin("example.com", "")).collect())
    expected = Counter()
    for page_id, url, *_ in rows:
        host, path, rule, says = brute(url)
        expected[page_id, host, path, rule, says or ("block" if host in ("example.com", "") else "allow")] += 1
    assert got == expected
    assert judge_urls(pages.where("false"), F.lit(False)).count() == 0


def test_split_is_linear_in_expressions(spark):
    frame = spark.createDataFrame([("http://A.b/c?d",)], "url string")
    host, path = host_and_path(F.col("url"))
    assert tuple(frame.select(host, path).first()) == ("a.b", "/c")
