"""Random people as a baseline, drawn without replacement and without pairing users with users.

Every drawing user has a permutation of everybody of its own: a Feistel network over the positions 0..N-1 whose round
keys come from the user's id.  The j-th person drawn is what the permutation makes of j, so a user's people are
distinct and any set of them is as likely as any other, as in a shuffled list, without a list being made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.operators.ranking import dense_index
from langshift.operators.skew import looked_up
from langshift.operators.storage import materialise

DRAWS_PER_ROW = 10_000
PRIME = 2**31 - 1  # products of two remainders stay within a long
ROUNDS = 4
WALK = 64  # steps back into 0..N-1; of the at most sqrt(N) places outside, a step leaves one in sqrt(N) outside


def positions(users: DataFrame) -> DataFrame:
    """(id, position): everybody numbered from 0, by id."""
    return dense_index(users.select("id"), [F.col("id")], "position")


def round_keys(key: Column, seed: int) -> Column:
    """Two numbers below PRIME for each round, as an array of structs (p, q)."""
    digests = [F.md5(F.concat_ws(":", key, F.lit(seed), F.lit(part))) for part in range(ROUNDS // 2)]
    hexes = [F.substring(digest, 1 + 8 * at, 8) for digest in digests for at in range(4)]
    numbers = [F.pmod(F.conv(text, 16, 10).cast("long"), F.lit(PRIME)) for text in hexes]
    return F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in zip(numbers[::2], numbers[1::2], strict=True)])


def _cubed(value: Column) -> Column:
    return F.pmod(F.pmod(value * value, F.lit(PRIME)) * value, F.lit(PRIME))


def _mixed(value: Column, key: Column) -> Column:
    return _cubed(F.pmod(value + key, F.lit(PRIME)))


def _network(place: Column, wide: Column, high: Column, keys: Column) -> Column:
    """A permutation of 0..wide*high-1: the place as (left, right), each half moved by a mix of the other."""
    start = F.struct((F.floor((place - F.pmod(place, high)) / high)).cast("long").alias("l"), F.pmod(place, high).alias("r"))

    def turn(halves: Column, key: Column) -> Column:
        left = F.pmod(halves["l"] + _mixed(halves["r"], key["p"]), wide)
        return F.struct(left.alias("l"), F.pmod(halves["r"] + _mixed(left, key["q"]), high).alias("r"))

    return F.aggregate(keys, start, turn, lambda halves: halves["l"] * high + halves["r"])


def _network_columns(rows: DataFrame, place: str, keys: str, name: str) -> DataFrame:
    """`_network` of a column, one step a column: generated code throughout, where a lambda is interpreted row by row."""
    wide, high = F.col("_wide"), F.col("_high")
    sides = {"_left": F.floor((F.col(place) - F.pmod(F.col(place), high)) / high).cast("long"), "_right": F.pmod(F.col(place), high)}
    rows = rows.withColumns(sides)
    for number in range(ROUNDS):
        key = F.col(keys)[number]
        for moved, other, part, size in (("_left", "_right", "p", wide), ("_right", "_left", "q", high)):
            rows = rows.withColumn("_shifted", F.pmod(F.col(other) + key[part], F.lit(PRIME)))
            rows = rows.withColumn(moved, F.pmod(F.col(moved) + _cubed(F.col("_shifted")), size))
    return rows.withColumn(name, F.col("_left") * high + F.col("_right")).drop("_left", "_right", "_shifted")


def permuted(rows: DataFrame, place: str, size: str, keys: str, name: str) -> DataFrame:
    """Add where the permutation of 0..size-1 with these keys takes each place.

    The network works on the least rectangle with about equal sides that holds `size` places; where it leads outside it is
    applied again until it comes back, which keeps it a permutation.  Only those few rows take the interpreted form.
    """
    size_ = F.col(size)
    rows = rows.withColumn("_wide", F.ceil(F.sqrt(size_.cast("double"))).cast("long"))
    rows = rows.withColumn("_high", F.expr(f"cast(({size} + _wide - 1) div _wide as long)"))
    once = lambda x: _network(x, F.col("_wide"), F.col("_high"), F.col(keys))
    rows = _network_columns(rows, place, keys, name)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(name), lambda x, _: F.when(x < size_, x).otherwise(once(x)))
    return rows.withColumn(name, F.when(F.col(name) < size_, F.col(name)).otherwise(again)).drop("_wide", "_high")


def draw_people(drawers: DataFrame, users: DataFrame, seed: int = 42, stage: bool = False) -> DataFrame:
    """For each (id, degree), `degree` different people out of all users: (source_id, dest_id, drawn).

    A simple random sample without replacement for each user, independent of those of others.  More draws than there
    are users give everybody once.  With `stage` the places drawn are written before people are looked up: for a join the
    planner carries the definition of each step of the network into those of the next, which takes it long.
    """
    spark = users.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    people = users.agg(F.count(F.lit(1)).alias("people")).scalar()
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("draws") - 1) / DRAWS_PER_ROW)))
    first = F.col("chunk") * DRAWS_PER_ROW
    last = F.least(first + DRAWS_PER_ROW, F.col("draws")) - 1
    drawn = (
        drawers.select(F.col("id").alias("source_id"), F.least("degree", people).alias("draws"), people.alias("people"))
        .where("draws > 0")
        .withColumn("chunk", chunk)
        .repartition(tasks, "source_id", "chunk")
        .withColumn("keys", round_keys(F.col("source_id"), seed))
        .withColumn("j", F.explode(F.sequence(first, last)))
        .select("source_id", "j", "draws", "people", "keys")
    )
    # Never null, or the planner would infer a filter for the join and copy the whole network into it, step into step.
    position = F.coalesce("position", F.lit(-1).cast("long")).alias("position")
    placed = permuted(drawn, "j", "people", "keys", "position").select("source_id", position, F.col("draws").alias("drawn"))
    return (
        (materialise(placed, "drawn") if stage else placed)
        .join(looked_up(positions(users), users.count()), "position")
        .select("source_id", F.col("id").alias("dest_id"), "drawn")
    )
