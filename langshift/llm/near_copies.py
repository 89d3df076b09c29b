"""Near copies by five-word shingles: SimHash groups first, then every pair of Jaccard similarity 0.8 or more.

Two texts link when their sets of shingles have a Jaccard similarity of at least 4/5, and what links, directly or
through others, is one group.  No pair is left to chance.

1. Equal sets are one class.  Each class has its size, a SimHash fingerprint, and a parity sketch: a bitmap, about twice
   as wide as the set is large, of which each shingle flips one bit.
2. The Gray-order index groups the fingerprints within three bits.  The members of a group are compared with its first
   one, exactly, so most of what is nearly equal is settled with one comparison each.
3. In any one order of all shingles, two similar sets share a shingle among the first n - ceil(4n/5) + 1 of each (n its
   size), so only these are shuffled, once.  The order puts shingles that are frequent in a bounded sample last, which
   decides the work but not the result.  Classes that share such a shingle and are of like size (else they can't be
   similar) form a family.
4. In a family sketches are compared: two sets differ by at least as many shingles as their sketches differ in bits, so
   whoever is too far from everybody (but those it is settled with) leaves the family, and no similar pair is lost.
5. What is left of a family is compared exactly.  A family of more than BLOCK_SHINGLES is first settled against its
   first member and sifted again, and is then cut into blocks, each two of which are a task of their own, so that no
   task gets an unbounded family.  A task reports a spanning forest of links, each of them verified, never all pairs.

Defined results: words are what ASCII white space separates, with ASCII letters lowered; a text of fewer words than a
shingle is one shingle; very long texts are read whole; null and blank texts have no shingle and are copies of each
other; repeated rows are copies; shingles are compared by 64-bit hashes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_digest

from langshift.llm import simhash_gray
from langshift.llm.components import connected_components
from langshift.operators.storage import materialise

SHINGLE = 5
SHARED, OF = 4, 5  # the least similarity is SHARED / OF
SAMPLE = 4_000  # texts whose shingles are counted to find frequent ones
FREQUENT = 3  # texts of the sample that a frequent shingle is in
MOST_FREQUENT = 1 << 18
BLOCK_SHINGLES = 1 << 20
SKETCH_BLOCK = 1 << 22  # shingles of the sets whose sketches one block holds
BROADCAST_IDS = 1 << 20  # rows of eight bytes up to which a counted table of ids is broadcast
CHUNK_WORDS = 1 << 21  # words of sketches compared at once
CACHED_DIGESTS = 1 << 17
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The ascending distinct hashes of the SHINGLE-word shingles of a UTF-8 text."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxh64_digest, words)), ">u8").astype(np.uint64)
    width = min(SHINGLE, len(words))
    many, more, shift = _MIX
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ (mixed >> shift)) * many + hashes[k : k + len(mixed)]
    mixed = (mixed ^ (mixed >> shift)) * more
    return np.unique(mixed ^ (mixed >> shift))


def leading(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one: the first in the order of (frequent, hash)."""
    n = len(shingles)
    first = n - -(-SHARED * n // OF) + 1 if n else 0
    if len(frequent):
        place = np.searchsorted(frequent, shingles).clip(max=len(frequent) - 1)
        shingles = shingles[np.argsort(frequent[place] == shingles, kind="stable")]
    return shingles[:first]


def sketch(shingles: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, at least 64 and twice the set, in which each shingle flips one bit."""
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def simhash(shingles: np.ndarray) -> int:
    """The fingerprint of a set, as a signed long: a bit is set if most shingles have it."""
    counts = np.zeros(simhash_gray.BITS, np.int64)
    for first in range(0, len(shingles), 1 << 16):
        part = np.ascontiguousarray(shingles[first : first + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big", signed=True)


def frequent_shingles(rows: DataFrame, key: str, text: str) -> np.ndarray:
    """Ascending hashes of shingles that many texts of a sample have; how many come back is bounded."""
    parts = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == 0).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(value).view(np.int64))], names=["shingle"])

    counts = sample.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    return np.sort(np.array([r["shingle"] for r in top.select("shingle").collect()], np.int64).view(np.uint64))


def linked(sets: list[np.ndarray], roots: list) -> list[tuple[int, int]]:
    """Links, each a similar pair, that connect the positions whose sets are similar as all pairs would.

    Positions of one root are known to belong together.
    """
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owners = owner[np.argsort(place, kind="stable")]
    ends = np.cumsum(np.bincount(place, minlength=len(values)))
    starts = np.concatenate(([0], ends[:-1]))
    first = np.concatenate(([0], np.cumsum(size)))
    _, root = np.unique(np.array(roots, object).astype(str), return_inverse=True)
    links, todo, open_ = [], [], np.ones(len(sets), bool)
    left = len(sets)
    for seed in range(len(sets)):
        if not left:
            break
        if not open_[seed]:
            continue
        found = np.flatnonzero(open_ & (root == root[seed]))
        while True:
            open_[found], left = False, left - len(found)
            todo += found.tolist()
            if not todo or not left:
                todo = []
                break
            i = todo.pop()
            own = place[first[i] : first[i + 1]]
            own = own[ends[own] - starts[own] > 1]
            found = np.empty(0, np.int64)
            if len(own):
                others = np.concatenate([owners[a:b] for a, b in zip(starts[own], ends[own], strict=True)])
                both = np.bincount(others, minlength=len(sets))
                met = np.flatnonzero(open_ & (OF * both >= SHARED * (size + size[i] - both)))
                links += [(i, int(j)) for j in met]
                found = np.flatnonzero(open_ & np.isin(root, root[met])) if len(met) else found
    return links


def sifted(sizes: np.ndarray, sketches: list[bytes], roots: list) -> np.ndarray:
    """Which sets may be similar, by their sketches, to one of another root."""
    least = min(map(len, sketches))
    bits = np.zeros((len(sketches), least // 8), np.uint64)
    for i, raw in enumerate(sketches):  # a wider sketch folds onto a narrower one
        bits[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, least // 8), axis=0)
    _, root = np.unique(np.array(roots, object).astype(str), return_inverse=True)
    alive, step = np.zeros(len(sizes), bool), max(1, CHUNK_WORDS // max(1, bits.size))
    for first in range(0, len(sizes), step):
        part = slice(first, first + step)
        apart = np.bitwise_count(bits[part, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
        near = ((OF + SHARED) * apart <= (OF - SHARED) * (sizes[part, None] + sizes[None])) & (root[part, None] != root[None])
        alive[part] |= near.any(axis=1)
    return alive


class Families:
    """Reads rows (shingle, n, name) in that order and names the families that they make.

    Sets of like size are at most one band of sizes apart.  A row of band b is in two families of its shingle, of the
    bands b - 1 and b and of the bands b and b + 1; a family has the name of its first row.
    """

    def __init__(self):
        self.last: tuple[int, int, int, int | None] | None = None  # shingle, band, first name, first name of the band before

    def __call__(self, shingle: np.ndarray, n: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(family, name) of the rows, without those that name a family."""
        band = np.floor(np.log(n) / math.log(OF / SHARED) + 1e-9).astype(np.int64)
        change = np.ones(len(shingle), bool)
        change[1:] = (shingle[1:] != shingle[:-1]) | (band[1:] != band[:-1])
        heads = np.flatnonzero(change)
        first, before = name[heads].copy(), name[heads].copy()
        next_to = (shingle[heads[1:]] == shingle[heads[:-1]]) & (band[heads[1:]] == band[heads[:-1]] + 1)
        known = self.last
        if known and known[0] == shingle[0]:
            if known[1] == band[0]:
                first[0], before[0] = known[2], known[2] if known[3] is None else known[3]
            elif known[1] + 1 == band[0]:
                before[0] = known[2]
        before[1:][next_to] = first[:-1][next_to]
        own = np.cumsum(change) - 1
        self.last = (int(shingle[-1]), int(band[-1]), int(first[-1]), int(before[-1]))
        two = np.concatenate((first[own], before[own])), np.concatenate((name, name))
        keep = two[0] != two[1]
        pairs = np.unique(np.stack((two[0][keep], two[1][keep]), axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _forest(schema: pa.Schema):  # noqa: ANN202
    def run(family: pa.Table) -> pa.Table:
        names = family["class"]
        pairs = linked([np.frombuffer(x, np.uint64) for x in family["shingles"].to_pylist()], family["root"].to_pylist())
        ends = [names.take(pa.array([p[k] for p in pairs], pa.int64())).combine_chunks() for k in (0, 1)]
        return pa.Table.from_arrays([x.cast(schema.field(0).type) for x in ends], names=["src", "dst"])

    return run


def _star(schema: pa.Schema):  # noqa: ANN202
    def run(star: pa.Table) -> pa.Table:
        """Links of the members that are similar to their centre."""
        names, centre = star["class"].to_pylist(), star["centre"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in star["shingles"].to_pylist()]
        middle = sets[names.index(centre)]
        both = [len(np.intersect1d(middle, s, assume_unique=True)) for s in sets]
        near = [OF * b >= SHARED * (len(middle) + len(s) - b) for b, s in zip(both, sets, strict=True)]
        found = [x for x, similar in zip(names, near, strict=True) if similar and x != centre]
        return pa.table([pa.array(x, schema.field(0).type) for x in (found, [centre] * len(found))], names=["src", "dst"])

    return run


def _grid(members: DataFrame, block: int) -> DataFrame:
    """Rows (family, class, n, ...) with the tasks (low, high) of their family: any two of its rows meet in one."""
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    return placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other", "blocks")


class NearCopies:
    """The search over one table of texts with a key that is unique and not null."""

    def __init__(self, rows: DataFrame, key: str, text: str, block: int):
        self.key, self.block, self.sketch_block = key, block, block * (SKETCH_BLOCK // BLOCK_SHINGLES)
        self.kind = rows.schema[key].dataType.simpleString()
        self.texts = rows.select(F.col(key).alias("member"), F.col(text).alias("_text"))
        self.arrow = pa.schema([("src", self.texts.limit(0).select("member").toArrow().schema.field(0).type)])
        self.frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, key, text))

    def seen(self) -> DataFrame:
        """(member, digest, name, n, sketch, fp) of every text; written."""

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
                digests = [xxh3_128_digest(s.tobytes()) for s in sets]
                columns = (
                    batch.column(0), pa.array(digests, pa.binary()), pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array(map(sketch, sets), pa.binary()), pa.array(map(simhash, sets), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(list(columns), names=["member", "digest", "name", "n", "sketch", "fp"])

        shape = f"member {self.kind}, digest binary, name bigint, n int, sketch binary, fp bigint"
        return materialise(self.texts.mapInArrow(look, shape), "shingles")

    def families(self) -> DataFrame:
        """(family, name): names of classes that share a leading shingle and are of like size; written."""
        frequent = self.frequent

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[bytes] = set()
            for batch in batches:
                parts = []
                for value in batch.column(0).cast(pa.binary()).to_pylist():
                    shingles = shingle_set(value)
                    digest = xxh3_128_digest(shingles.tobytes())
                    if digest in done:
                        continue
                    if len(done) >= CACHED_DIGESTS:
                        done.clear()
                    done.add(digest)
                    first = leading(shingles, frequent.value).view(np.int64)
                    name = int.from_bytes(digest[:8], "big", signed=True)
                    parts.append((first, np.full(len(first), len(shingles), np.int32), np.full(len(first), name, np.int64)))
                if parts:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shingle", "n", "name"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            families = Families()
            for batch in batches:
                if batch.num_rows:
                    pairs = families(*(batch.column(c).to_numpy() for c in range(3)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["family", "name"])

        entries = self.texts.select("_text").mapInArrow(look, "shingle bigint, n int, name bigint")
        sorted_ = entries.repartition("shingle").sortWithinPartitions("shingle", "n", "name")
        return materialise(sorted_.mapInArrow(meet, "family bigint, name bigint").distinct(), "families")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(class, shingles) of the texts named in a written table (class) without repeats."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(x).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "shingles"])

        wanted = ids.select(F.col("class").alias("member"))
        wanted = F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted
        return self.texts.join(wanted, "member", "left_semi").mapInArrow(whole, f"class {self.kind}, shingles binary")

    def stars(self, pairs: DataFrame) -> DataFrame:
        """(src, dst) of the (class, n, centre) that are similar to their centre; written."""
        stored = materialise(pairs.select("class", "n", "centre"), "star-pairs")
        sizes = stored.groupBy("centre").agg(F.ceil(F.sum("n") / self.block).cast("int").alias("pieces"))
        piece = F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int").alias("piece")
        members = stored.join(sizes, "centre").select("centre", piece, "class")
        middles = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("centre").alias("class"))
        placed = members.unionByName(middles)
        sets = self.sets(materialise(placed.select("class").distinct(), "star-ids"))
        met = placed.join(sets, "class").groupBy("centre", "piece").applyInArrow(_star(self.arrow), f"src {self.kind}, dst {self.kind}")
        return materialise(met, "star-links")

    def sift(self, members: DataFrame) -> DataFrame:
        """The rows (family, class, n, sketch, root) that may be similar to one of another root in their family."""
        schema = self.arrow

        def run(family: pa.Table) -> pa.Table:
            alive = sifted(family["n"].to_numpy(), family["sketch"].to_pylist(), family["root"].to_pylist())
            kept = family.select(["family", "class", "n", "root"]).filter(pa.array(alive))
            kind = schema.field(0).type
            columns = [kept["family"].cast(pa.int64()), kept["class"].cast(kind), kept["n"].cast(pa.int32()), kept["root"].cast(kind)]
            return pa.Table.from_arrays(columns, names=["family", "class", "n", "root"])

        shape = f"family bigint, class {self.kind}, n int, root {self.kind}"
        tasks = _grid(members, self.sketch_block).repartition("family", "low", "high")  # else a family would stay in one task
        return tasks.groupBy("family", "low", "high").applyInArrow(run, shape).distinct()

    def forest(self, alive: DataFrame) -> DataFrame:
        """(src, dst) that connect what is similar among the rows (family, class, n, root) of each family; written."""
        sets = self.sets(materialise(alive.select("class").distinct(), "family-ids"))
        tasks = _grid(alive, self.block).join(sets, "class").groupBy("family", "low", "high")
        return materialise(tasks.applyInArrow(_forest(self.arrow), f"src {self.kind}, dst {self.kind}"), "verified-links")


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the smallest class that the links lead to, as `root`."""
    joined = connected_components(links).select(F.col("node").alias("class"), F.col("component").alias("_root"))
    rooted = classes.drop("root").join(joined, "class", "left")
    return rooted.withColumn("root", F.coalesce("_root", "class")).drop("_root")


def near_copies(rows: DataFrame, key: str, text: str = "text", block: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, component_id) for each row, by a key that is unique and not null; component_id is the group's smallest key."""
    search = NearCopies(rows, key, text, block)
    seen = search.seen()
    same = ("name", "n", "sketch", "fp")
    classes = seen.groupBy("digest").agg(F.min("member").alias("class"), *[F.any_value(c).alias(c) for c in same])
    classes = materialise(classes, "equal-sets")

    prints = classes.where("n > 0").select("class", "fp")
    grouped = simhash_gray.gray_components(prints, "class").where(F.col("class") != F.col("component_id"))
    grouped = grouped.select("class", F.col("component_id").alias("centre"))
    links = search.stars(classes.select("class", "n").join(grouped, "class"))
    classes = materialise(_rooted(classes, links), "settled")

    known = classes.select("name", "class", "n", "sketch", "root")
    families = search.families()
    heads = families.select("family").distinct().select("family", F.col("family").alias("name"))
    members = families.unionByName(heads).join(known, "name").drop("name")
    alive = materialise(search.sift(members), "alive")
    sums = alive.groupBy("family").agg(F.sum("n").alias("_sum"), F.min("class").alias("centre"))
    large = materialise(sums.where(F.col("_sum") > block).select("family", "centre"), "large-families")
    if not large.isEmpty():
        close = alive.join(large, "family").where(F.col("class") != F.col("centre")).select("class", "n", "centre").distinct()
        links = links.unionByName(search.stars(close))
        roots = _rooted(classes.select("name", "class", "n", "sketch"), links)
        again = families.unionByName(heads).join(large.select("family"), "family", "left_semi").join(roots, "name").drop("name")
        rest = alive.join(large, "family", "left_anti")
        alive = materialise(rest.unionByName(search.sift(again).select(*rest.columns)), "alive-again")

    links = links.unionByName(search.forest(alive))
    roots = materialise(_rooted(classes.select("digest", "class"), links).select("digest", F.col("root").alias("component_id")), "copies")
    return seen.select("member", "digest").join(roots, "digest").select(F.col("member").alias(key), "component_id")
