"""URL verdicts from a Bloom filter cascade, with built-in expressions only.

Level 0 of a cascade is a Bloom filter over the listed keys.  Level 1 encodes the unlisted keys that level 0 lets
through, level 2 the listed keys that level 1 lets through, and so on over the complete universe of keys until a level
lets nothing wrong through.  A key is listed exactly when the first level that rejects it is an odd one (or the last
level that accepts it an even one), so each row is decided by expressions alone: no join, and no error.

The filters reach the tasks as scalar subqueries.  They take six bits per encoded key and level, so that their size is
known from counts before they are built.  Beyond `limit_bytes` the universe is cut by a hash of the key into as many
parts as keep the filters of each within it: the rows are written once, a folder a part, and every part is decided in a
job of its own by its own cascade, so no task ever holds more than one part's filters, and rows are not shuffled.

Defined results: a null url or one without `://` has an empty host and path and follows no rule; the empty host is a
key like any other, and so is a very long one; a null key is not listed; repeated rows are judged alike; an empty table
gives an empty result; `judge_urls` ignores other columns and `mark_listed` keeps them, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.llm.rows import free_name
from langshift.operators.storage import materialise, stage_path

BITS_PER_KEY = 6
HASHES = 4
PASSED = (1 - math.exp(-HASHES / BITS_PER_KEY)) ** HASHES  # share of other keys that a level lets through
MARGIN = 1.25  # over the expected size of a part's filters
WORD = 64
LIMIT_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substr(url, found + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, tail = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    """One filter: a table with a single row holding all 64-bit words, and its size in bits."""

    words: DataFrame
    bits: int
    number: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits)) for j in range(HASHES)]

    def accepts(self, key: Column) -> Column:
        words = self.words.scalar()
        word = [F.get(words, F.floor(p / WORD).cast("int")) for p in self.places(key)]
        bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(WORD)).cast("int")) for p in self.places(key)]
        return reduce(lambda a, b: a & b, [w.bitwiseAND(m) != 0 for w, m in zip(word, bit, strict=True)])


def _level(keys: DataFrame, rows: int, number: int) -> Level:
    """Encode the keys of a table with `rows` rows."""
    spark = keys.sparkSession
    bits = -(-max(1, rows * BITS_PER_KEY) // WORD) * WORD
    level = Level(keys, bits, number)
    place = F.explode(F.array(*level.places(F.col("key")))).alias("place")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(WORD)).cast("int"))
    marks = keys.select(place).select(F.floor(F.col("place") / WORD).cast("long").alias("word"), mask.alias("mask"))
    empty = spark.range(bits // WORD).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = marks.unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    packed = words.agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("all"))
    return Level(materialise(packed.select(F.col("all.mask").alias("words")), "bloom"), bits, number)


class Cascade:
    """Exact membership for every key of a written universe of distinct keys (key, listed), by its filters."""

    def __init__(self, keys: DataFrame):
        self.levels: list[Level] = []
        encode, other = keys.where("listed").select("key"), keys.where("not listed").select("key")
        rows = encode.count()
        while rows:
            level = _level(encode, rows, len(self.levels))
            self.levels.append(level)
            wrong = materialise(other.where(level.accepts(F.col("key"))), "cascade-wrong")
            encode, other, rows = wrong, encode, wrong.count()

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed, as an expression over the filters."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.accepts(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


def distinct_keys(universe: DataFrame) -> DataFrame:
    """The universe (key, listed) written with one row a key; a key is listed if any of its rows says so."""
    keys = universe.where("key is not null").groupBy("key").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    return materialise(keys, "cascade-keys")


def parts_within(keys: DataFrame, limit_bytes: int) -> int:
    """Parts in which the filters of distinct keys (key, listed) take at most `limit_bytes` each."""
    counts = keys.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    encoded = (counts["listed"] + PASSED * counts["others"]) / (1 - PASSED)
    return max(1, math.ceil(MARGIN * encoded * BITS_PER_KEY / 8 / limit_bytes))


def _in_folders(rows: DataFrame, key: str, parts: int, name: str) -> tuple[DataFrame, str]:
    """The rows written to a folder for each part of the keys, and the column that selects a folder."""
    part = free_name(rows, "_part")
    number = F.pmod(F.xxhash64(F.col(key), F.lit(-1)), F.lit(parts)).cast("int")
    placed, path = rows.withColumn(part, number), stage_path(rows.sparkSession, name)
    placed.write.partitionBy(part).parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path), part


def mark_listed(rows: DataFrame, universe: DataFrame, key: str, name: str, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Add a boolean column that tells which rows' keys the universe (key, listed) lists; it holds all keys of the rows."""
    keys = distinct_keys(universe)
    parts = parts_within(keys, limit_bytes)
    if parts == 1:
        return rows.withColumn(name, Cascade(keys).contains(F.col(key)))
    stored, part = _in_folders(rows, key, parts, "cascade-rows")
    keys, key_part = _in_folders(keys, "key", parts, "cascade-parts")
    marked = []
    for number in range(parts):
        cascade = Cascade(keys.where(F.col(key_part) == number))
        own = stored.where(F.col(part) == number).drop(part)
        marked.append(materialise(own.withColumn(name, cascade.contains(F.col(key))), "cascade-marked"))
    return reduce(DataFrame.unionAll, marked)


def judge_urls(
    pages: DataFrame,
    listed: Column,
    key: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    limit_bytes: int = LIMIT_BYTES,
) -> DataFrame:
    """(key, host, path, rule, verdict): the longest rule decides, else membership of the host in the list.

    `listed` is a condition on the column `key` that tells which hosts of the corpus the blocklist names.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    universe = split.select(F.col("host").alias("key")).distinct().withColumn("listed", listed)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = mark_listed(split, universe, "host", "_listed", limit_bytes).withColumn("rule", rule)
    own = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", F.coalesce(verdict, own)).drop("_listed")
