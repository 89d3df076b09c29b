"""Do changes of language point towards the friends?

For a kept user and a topic, with zero-filled scores s0, s1 and the averages of friends and of the
baseline over the reference slice:

    tt = s1 - s0        tf = friend_avg - s0        tr = base_avg - s0

Only *support* rows exist, cells with a non-zero part.  A baseline that is one constant `a` per topic is
kept out of them and enters the sums by algebra: with `friend_flag` and `base_flag` (0 or 1 per user)

    tf = x + friend_flag * a,    tr = y + base_flag * a,    x = friend_avg - s0,  y = base_avg - s0

where x and y hold the sparse parts.  Shifting and scaling all slices of a topic alike cancels in the
cosines and slopes, so raw scores are used and only intercept and error are divided by the scale.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langshift.functions.columns import snapped
from langshift.operators.skew import fan_out_join
from langshift.operators.storage import materialise

RANK_EPS = 1e-24  # square of the angle between the regressors up to which they count as collinear
BLOCK_TOPICS = 512  # about so many scores travel in one row
VECTOR_BITS = 5  # topics whose numbers differ in these last bits only share a vector
VECTOR_FILL = 0.25  # vectors are used where at least this part of their places is filled
LINKS_PER_TASK = 20_000  # links of one user that a task gathers
MAP_SIDE_BYTES = 16 << 20  # packed scores that are copied to every task; the driver holds several times as much while it deals them out
ROW_BYTES, SCORE_BYTES = 64, 40  # of a packed row in memory, without and for each of its scores
VECTOR_ROW_BYTES, PLACE_BYTES = 96, 8  # the same of a row with a vector
NOISE = 1e-28  # square of a double's relative rounding, with room


Hot = tuple[DataFrame | None, DataFrame | None]
Parts = tuple[DataFrame | None, DataFrame | None]  # heavy and light


def score_blocks(topic_count: int) -> int:
    return max(1, -(-topic_count // BLOCK_TOPICS))


def packed_scores(cells: DataFrame, blocks: int) -> DataFrame:
    """(dest_id, block, scores): a user's reference scores as arrays of (topic, s2), in blocks of bounded length."""
    block = F.pmod(F.xxhash64("topic"), F.lit(blocks)).cast("int").alias("block")
    return cells.groupBy(F.col("group_id").alias("dest_id"), block).agg(
        F.collect_list(F.struct("topic", "s2")).alias("scores")
    )


def vector_shape(topics: DataFrame, people: int) -> tuple[int, int] | None:
    """(blocks, places) if vectors of so many places suit the reference scores, None if most places would be empty.

    `topics` tells the number of a topic and how many of the `people` have a reference score for it (topic, cells).
    """
    block, place = F.shiftright("topic", VECTOR_BITS), F.col("topic").bitwiseAND((1 << VECTOR_BITS) - 1)
    shape = topics.agg(F.count_distinct(block).alias("blocks"), F.max(place).alias("last"), F.sum("cells").alias("cells")).first()
    if shape["last"] is None:
        return None
    places = shape["last"] + 1
    return (shape["blocks"], places) if shape["cells"] >= VECTOR_FILL * people * shape["blocks"] * places else None


def packed_vectors(cells: DataFrame, places: int) -> DataFrame:
    """(dest_id, block, vector): a user's reference scores, each at its topic's place in the block, NULL without a row.

    The cells of a user meet before they are packed, so that no half empty vectors move.
    """
    placed = cells.select(
        F.col("group_id").alias("dest_id"),
        F.shiftright("topic", VECTOR_BITS).alias("block"),
        F.col("topic").bitwiseAND((1 << VECTOR_BITS) - 1).cast("int").alias("place"),
        "s2",
    )
    scores = [F.max(F.when(F.col("place") == place, F.col("s2"))).alias(f"s{place}") for place in range(places)]
    wide = placed.repartition("dest_id", "block").groupBy("dest_id", "block").agg(*scores)
    return wide.select("dest_id", "block", F.struct(*(f"s{place}" for place in range(places))).alias("vector"))


def _places(packed: DataFrame) -> int:
    """The places of a vector; 0 if scores are packed otherwise."""
    return len(packed.schema["vector"].dataType.fields) if "vector" in packed.columns else 0


def map_side_people(
    followed: DataFrame, packed: DataFrame, blocks: int = 1, max_bytes: int = MAP_SIDE_BYTES
) -> tuple[DataFrame | None, DataFrame | None]:
    """The packed scores to copy to every task, and the rest: (heavy, light); None for a part that is empty.

    Heavy are the people whom most links in `followed` (dest_id) lead to, as many as surely fit `max_bytes` with `blocks`
    rows each: the longest array is measured and counts for all.  So the copies have a proven bound, whatever the number of people.
    """
    longest = F.lit(_places(packed)) if _places(packed) else F.max(F.size("scores"))
    facts = packed.agg(F.count(F.lit(1)).alias("rows"), longest.alias("longest")).first()
    if not facts["rows"]:
        return None, packed
    row_bytes = VECTOR_ROW_BYTES + PLACE_BYTES * facts["longest"] if _places(packed) else ROW_BYTES + SCORE_BYTES * facts["longest"]
    if facts["rows"] * row_bytes <= max_bytes:
        return packed, None
    people = max_bytes // (row_bytes * blocks)
    if not people:
        return None, packed
    most = followed.groupBy("dest_id").agg(F.count(F.lit(1)).alias("_links")).orderBy(F.desc("_links"), "dest_id").limit(people)
    chosen = materialise(most.select("dest_id"), "most-followed")
    heavy = materialise(packed.join(chosen, "dest_id", "left_semi"), "heavy-scores")
    return heavy, packed.join(chosen, "dest_id", "left_anti")


@dataclass(frozen=True)
class Adding:
    """How values are added: `parts` of each are summed apart, `total` makes one number of the sums."""

    parts: Callable[[Column], list[Column]] = lambda value: [value]
    total: Callable[[list[Column]], Column] = lambda sums: sums[0]

    def names(self, name: str) -> list[str]:
        return [f"{name}_{number}" for number in range(len(self.parts(F.lit(0.0))))]

    def named(self, value: Column, name: str) -> list[Column]:
        return [part.alias(part_name) for part, part_name in zip(self.parts(value), self.names(name))]


PLAIN = Adding()


def neighbour_sums(
    links: DataFrame,
    heavy: DataFrame | None,
    light: DataFrame | None,
    shares: list[str],
    hot: Hot = (None, None),
    adding: Adding = PLAIN,
) -> DataFrame:
    """What the links of a user add to its averages: (id, topic, parts of each share), any number of rows to be summed.

    `links` are (source_id, dest_id, *shares); a share is the part this link has in an average of the
    source user.  Friends and drawn people are links with different shares, so one join serves both.

    Scores of the most-followed people are at hand in every task (`map_side_people`): their links are not moved at
    all, and an aggregation by user and topic combines them where they lie.  Links to others are shuffled.
    """
    share = F.greatest(*shares) if len(shares) > 1 else F.col(shares[0])
    found = []
    if heavy is not None:
        found.append(links.join(F.broadcast(heavy), "dest_id"))
    if light is not None:
        found.append(_met_links(links, light, share, hot))
    if _places(found[0]):
        return _vector_sums(reduce(DataFrame.unionByName, found), shares, adding)
    parts = [part for name in shares for part in adding.named(F.col("cell.s2") * F.col(name), name)]

    def unpacked(joined: DataFrame) -> DataFrame:
        rows = joined.select(F.col("source_id").alias("id"), *shares, F.explode("scores").alias("cell"))
        return rows.select("id", F.col("cell.topic").alias("topic"), *parts)

    return reduce(DataFrame.unionByName, map(unpacked, found))


def _vector_sums(joined: DataFrame, shares: list[str], adding: Adding) -> DataFrame:
    """The same from links joined with vectors: one aggregation by user adds up all places of a link at once."""
    names, places = [name for share in shares for name in adding.names(share)], range(_places(joined))
    sums = [
        F.sum(part).alias(f"{name}_{place}")
        for place in places
        for share in shares
        for part, name in zip(adding.parts(F.col(f"vector.s{place}") * F.col(share)), adding.names(share))
    ]
    wide = joined.withColumnRenamed("source_id", "id").groupBy("id", "block").agg(*sums)
    topics = F.shiftleft("block", VECTOR_BITS)
    cells = [
        F.struct((topics + place).alias("topic"), *(F.col(f"{name}_{place}").alias(name) for name in names)) for place in places
    ]
    cell = F.col("cell")
    return wide.select("id", F.explode(F.array(*cells)).alias("cell")).where(cell[names[0]].isNotNull()).select("id", "cell.*")


def _met_links(links: DataFrame, packed: DataFrame, share: Column, hot: Hot) -> DataFrame:
    """The links with packed scores, those of a user and block of topics in one task.

    The join and the shuffle behind it move one row per link and block of topics.  The arrays are unpacked
    where all links of a user have met, so that an aggregation combines them before anything moves again.
    A user with very many links, which its shares tell, is dealt to several tasks.
    """
    joined = fan_out_join(
        links, packed, "dest_id", left_hot=hot[0], right_hot=hot[1], left_spread=("source_id",), right_spread=("block",)
    )
    pieces = F.ceil(1 / (share * LINKS_PER_TASK))
    piece = F.coalesce(F.pmod(F.xxhash64("dest_id"), pieces), F.lit(0))
    return joined.repartition("source_id", "block", piece)


def topic_averages(neighbours: DataFrame, share: str, name: str) -> DataFrame:
    """(id, topic, name): one of the averages per user and topic; no row where it is zero throughout."""
    return neighbours.groupBy("id", "topic").agg(F.sum(*PLAIN.names(share)).alias(name))


def support_rows(
    own: DataFrame, neighbours: DataFrame, baseline: str, unaveraged: bool = False, adding: Adding = PLAIN
) -> DataFrame:
    """(id, topic, tt, x, y, friend_flag, base_flag) for every non-zero cell of a kept user.

    `own` are the kept users' (group_id, topic, s0, s1).  With `unaveraged` they also carry that flag:
    users whose averages are unknown and stand at the mean over all users.  tt, x and y are sums of what
    the user's own rows and the neighbours' rows contribute, so one aggregation forms them, by `adding`.
    """
    zero, carried = F.lit(0.0), ["unaveraged"] if unaveraged else []
    s0, s1 = F.coalesce("s0", zero), F.coalesce("s1", zero)
    values = {"tt": s1 - s0, "x": -s0, "y": -s0}
    mine = own.select(
        F.col("group_id").alias("id"), "topic", *(part for name, value in values.items() for part in adding.named(value, name)), *carried
    )
    shares = {"x": "friend_share"} | ({"y": "base_share"} if baseline == "random" else {})

    def shared(name: str) -> list[Column]:
        parts = map(F.col, adding.names(shares[name])) if name in shares else adding.parts(zero)
        return [part.alias(part_name) for part, part_name in zip(parts, adding.names(name))]

    theirs = neighbours.select("id", "topic", *(part for name in values for part in shared(name)), *(F.lit(0).alias(name) for name in carried))
    sums = [adding.total([F.sum(part) for part in adding.names(name)]).alias(name) for name in values]
    cells = mine.unionByName(theirs).groupBy("id", "topic").agg(*sums, *(F.max(name).alias(name) for name in carried))
    flag = F.col("unaveraged") if unaveraged else F.lit(0)
    base_flag = flag if baseline == "random" else F.lit(1)
    return cells.select("id", "topic", "tt", "x", "y", flag.alias("friend_flag"), base_flag.alias("base_flag"))


def moments(
    support: DataFrame, topics: DataFrame, users: DataFrame, add: Callable[[Column], Column] = F.sum
) -> DataFrame:
    """Sums, raw and centred second moments of tt, tf and tr per topic over all kept users, zero cells included.

    The support rows carry `base_avg`, so that tf and tr are formed before they are squared.  The other
    users of a topic have tt = 0 and the same tf and tr wherever they have the same flags; they are added
    as terms of their own, never by subtracting from a total.  `add` forms the sums and the raw moments.
    """
    a, f, b = F.col("base_avg"), F.col("friend_flag"), F.col("base_flag")
    rows = support.select("topic", "friend_flag", "base_flag", "tt", (F.col("x") + f * a).alias("tf"), (F.col("y") + b * a).alias("tr"))
    values = ("tt", "tf", "tr")
    pairs = (("tf", "tf"), ("tr", "tr"), ("tf", "tr"), ("tt", "tf"), ("tt", "tr"))
    sums = rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("support"),
        *(add(F.col(name)).alias(f"sum_{name}") for name in values),
        add(F.col("tt") * F.col("tt")).alias("raw_tt_tt"),
        *(add(F.col(p) * F.col(q)).alias(f"raw_{p}_{q}") for p, q in pairs),
        *(F.covar_pop(p, q).alias(f"own_{p}_{q}") for p, q in pairs),
        F.sum(f).alias("sf"),
        F.sum(b).alias("sb"),
        F.sum(f * b).alias("sfb"),
    )
    totals = users.agg(
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("friend_flag"), F.lit(0)).alias("nf"),
        F.coalesce(F.sum("base_flag"), F.lit(0)).alias("nb"),
        F.coalesce(F.sum(F.col("friend_flag") * F.col("base_flag")), F.lit(0)).alias("nfb"),
    )
    packed = totals.select(F.struct("users", "nf", "nb", "nfb").alias("totals")).scalar()
    zeros = {name: 0 for name in ("support", "sf", "sb", "sfb")}
    zeros |= {name: 0.0 for name in sums.columns if name.startswith(("sum_", "raw_", "own_"))}
    n, k = F.col("totals.users"), F.col("support")
    rest_f, rest_b = F.col("totals.nf") - F.col("sf"), F.col("totals.nb") - F.col("sb")
    rest_fb, rest = F.col("totals.nfb") - F.col("sfb"), n - k

    def mean_of_support(name: str) -> Column:
        return F.when(k > 0, F.col(f"sum_{name}") / F.greatest(k, F.lit(1))).otherwise(F.lit(0.0))

    def mean_of_rest(name: str) -> Column:
        carried = {"tt": F.lit(0.0), "tf": rest_f * a, "tr": rest_b * a}[name]
        return F.when(rest > 0, carried / F.greatest(rest, F.lit(1))).otherwise(F.lit(0.0))

    def centred(p: str, q: str) -> Column:
        """Both groups about their own means, and the distance of these; the rest is one constant."""
        apart = (mean_of_support(p) - mean_of_rest(p)) * (mean_of_support(q) - mean_of_rest(q))
        return k * F.col(f"own_{p}_{q}") + k * rest / n * apart

    return (
        topics.join(sums, "topic", "left")
        .fillna(zeros)
        .withColumn("totals", packed)
        .where("totals.users > 0")
        .select(
            "feat",
            "topic",
            "divisor",
            "base_avg",
            n.alias("n"),
            "support",
            F.col("sum_tt").alias("t"),
            (F.col("sum_tf") + a * rest_f).alias("f"),
            (F.col("sum_tr") + a * rest_b).alias("r"),
            F.col("raw_tt_tt").alias("tt"),
            (F.col("raw_tf_tf") + a * a * rest_f).alias("ff"),
            (F.col("raw_tr_tr") + a * a * rest_b).alias("rr"),
            (F.col("raw_tf_tr") + a * a * rest_fb).alias("fr"),
            F.col("raw_tt_tf").alias("tf"),
            F.col("raw_tt_tr").alias("tr"),
            centred("tf", "tf").alias("sff"),
            centred("tr", "tr").alias("srr"),
            centred("tf", "tr").alias("sfr"),
            centred("tt", "tf").alias("stf"),
            centred("tt", "tr").alias("str"),
        )
    )


def _cosine(dot: str, left: str, right: str) -> Column:
    norms = F.sqrt(F.greatest(F.col(left), F.lit(0.0))) * F.sqrt(F.greatest(F.col(right), F.lit(0.0)))
    return F.when(norms > 0, F.col(dot) / norms).otherwise(F.lit(0.0))


def cosines(sums: DataFrame) -> DataFrame:
    """(feat, cos_friends, cos_base, cos_diff); a zero vector has cosine 0."""
    both = sums.select("feat", _cosine("tf", "tt", "ff").alias("cos_friends"), _cosine("tr", "tt", "rr").alias("cos_base"))
    return both.withColumn("cos_diff", snapped(F.col("cos_friends") - F.col("cos_base")))


def residual_sums(support: DataFrame, sums: DataFrame, baseline_flag: int, attach) -> DataFrame:
    """Moments of what is left of the baseline once the friends' part is taken out of it, row by row: (topic, left_*).

    This is the second column of an orthogonal triangle of the regressors.  It is formed from differences, not from
    products, so regressors that are nearly collinear keep the digits that their normal equations would lose.  All sums
    can be merged; `attach` joins the topics' means to the support rows, and users without one have the same residual.
    """
    n = F.col("n")
    centre = sums.select(
        "topic", "base_avg", n, "support", (F.col("f") / n).alias("mean_f"), (F.col("r") / n).alias("mean_r"),
        F.when(_spread("sff", "ff") > 0, F.col("sfr") / F.col("sff")).otherwise(F.lit(0.0)).alias("slope"),
    )
    f = F.col("x") + F.col("friend_flag") * F.col("base_avg") - F.col("mean_f")
    r = F.col("y") + F.col("base_flag") * F.col("base_avg") - F.col("mean_r")
    rows = attach(support, centre.drop("n", "support")).select("topic", "tt", f.alias("f"), (r - F.col("slope") * f).alias("e"))
    own = rows.groupBy("topic").agg(
        F.sum("e").alias("e"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("e") * F.col("f")).alias("ef"),
        F.sum(F.col("e") * F.col("tt")).alias("et"),
    )
    rest, constant = F.col("n") - F.col("support"), F.lit(baseline_flag) * F.col("base_avg") - F.col("mean_r") + F.col("slope") * F.col("mean_f")
    both = centre.withColumn("_e", constant).join(own, "topic", "left").fillna(0.0, ["e", "ee", "ef", "et"])
    return both.select(
        "topic", "slope", (F.col("e") + rest * F.col("_e")).alias("left_e"), (F.col("ee") + rest * F.col("_e") * F.col("_e")).alias("left_ee"),
        (F.col("ef") - rest * F.col("_e") * F.col("mean_f")).alias("left_ef"), F.col("et").alias("left_et"),
    )


def _spread(name: str, raw: str) -> Column:
    """A centred square, zero where it is no more than the rounding of the values themselves."""
    return F.when(F.col(name) > NOISE * F.col(raw), F.col(name)).otherwise(F.lit(0.0))


def least_squares(sums: DataFrame, residuals: DataFrame) -> DataFrame:
    """Fit tt ~ b_friends * tf + b_base * tr + c per topic, in raw scores.

    The triangle of the centred regressors is solved from below: the baseline's coefficient from what `residual_sums`
    left of it, then that of the friends.  Its last entry decides the rank: collinear regressors get the shortest
    solution.  A regressor whose spread is no more than the rounding of its own values counts as constant.
    """
    joined = sums.withColumns({"sff": _spread("sff", "ff"), "srr": _spread("srr", "rr")}).join(residuals, "topic")
    again = F.when(F.col("sff") > 0, F.col("left_ef") / F.col("sff")).otherwise(F.lit(0.0))
    centred = joined.withColumn("again", again).select(
        *sums.columns,
        (F.col("slope") + F.col("again")).alias("slope"),
        (F.col("left_ee") - F.col("again") * F.col("left_ef")).alias("see"),
        (F.col("left_et") - F.col("left_e") * F.col("t") / F.col("n") - F.col("again") * F.col("stf")).alias("sxt"),
        (F.col("sff") + F.col("srr")).alias("trace"),
    )
    full_rank = (F.col("sff") > 0) & (F.col("see") > RANK_EPS * F.col("srr"))
    some_rank = F.col("trace") > 0

    def solve(regular: Column, shortest: Column) -> Column:
        short = F.when(some_rank, shortest / (F.col("trace") * F.col("trace"))).otherwise(F.lit(0.0))
        return F.when(full_rank, regular).otherwise(short)

    b_friends = solve(F.expr("stf / sff - slope * sxt / see"), F.expr("sff * stf + sfr * str"))
    b_base = solve(F.expr("sxt / see"), F.expr("sfr * stf + srr * str"))
    return centred.withColumn("b_friends", b_friends).withColumn("b_base", b_base).select(
        "feat",
        "topic",
        "divisor",
        "base_avg",
        "n",
        "support",
        "b_friends",
        "b_base",
        F.expr("(t - b_friends * f - b_base * r) / n").alias("c"),
    )


def fit_errors(support: DataFrame, fits: DataFrame, baseline_flag: int, attach) -> DataFrame:
    """Mean absolute error of each fit over all kept users, and the intercept, both in normalised scores.

    `attach` joins the fits to the support rows; users without a support row all have the same residual.
    """
    residual = F.expr(
        "tt - b_friends * (x + friend_flag * base_avg) - b_base * (y + base_flag * base_avg) - c"
    )
    coefficients = fits.select("topic", "b_friends", "b_base", "base_avg", "c")
    errors = attach(support, coefficients).groupBy("topic").agg(F.sum(F.abs(residual)).alias("error"))
    rest = (F.col("n") - F.col("support")) * F.abs(F.col("b_base") * F.lit(baseline_flag) * F.col("base_avg") + F.col("c"))
    return fits.join(errors, "topic", "left").select(
        "feat",
        "b_friends",
        "b_base",
        (F.col("c") / F.col("divisor")).alias("intercept"),
        ((F.coalesce("error", F.lit(0.0)) + rest) / F.col("n") / F.col("divisor")).alias("mae"),
        "n",
    )


def summary(results: DataFrame) -> DataFrame:
    """Number of topics and the mean cosines."""
    return results.agg(
        F.count(F.lit(1)).alias("topics"),
        F.avg("cos_friends").alias("mean_cos_friends"),
        F.avg("cos_base").alias("mean_cos_base"),
    )
