"""Near-duplicate groups by b-bit MinHash.

Minima of K hash functions over a text's word shingles are cut into bands; texts
that share a band's minima are candidates. Of each minimum the low B bits are
packed into a signature; the differing lanes of two signatures are counted with
bit operations and, corrected for chance collisions, estimate the similarity.
Pairs whose estimate rules a link out go; links are confirmed on full shingle
sets, and the groups are the connected components of confirmed links.

Equal sets are one node, whatever the number of rows that have them. No bucket
is ever turned into all of its pairs. Every node is first compared with the
smallest one of all its buckets, then with the smallest one of each bucket whose
link to the same node isn't known yet, those that aren't linked to it with a
member drawn by hash, and components are taken. What a bucket then still holds in different
components is compared by signatures, in blocks, the largest component against
the rest and the rest among themselves; only texts that some signature in
another component comes near to are then read and compared, in blocks again. So
a link between different components is found whatever the size of the bucket.

Cases: texts that are null, empty or without words have no shingles and stay
alone; a text with fewer words than a shingle is one shingle; rows that repeat
an id are one document, linked by all of its texts, and get one component;
rows without an id get their group's smallest id, null if nothing in the group
has one (they are told as kept then); other columns don't matter; an empty
input gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BLANKS, Workspace, each_text, frugal

#: Low bits kept of each minimum, and lanes in a 64-bit word of the signature.
B = 4
LANES = 64 // B
#: Signatures, and texts and their bytes, on each side of a block comparison.
BLOCK, TEXT_BLOCK, TEXT_BYTES = 512, 64, 4 << 20
#: A linked pair's estimate rules it out at most so seldom.
MISSED = 1e-9


@dataclass(frozen=True)
class Plan:
    """Shingle width in words, similarity as a fraction of 100, bands and rows.

    28 bands of 5 rows find a pair of similarity 0.85 but for 1 in 10 million,
    and one of 0.80 but for 1 in 70,000.
    """

    width: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        """64-bit words of a signature."""
        return -(-self.hashes // LANES)

    @property
    def most_differ(self) -> int:
        """Lanes that may differ: more do so in a linked pair once in 1 / MISSED, by the binomial distribution.

        Of a pair at the threshold a lane differs if the minima do, but for
        chance collisions of their low bits.
        """
        q, n = (1 - self.percent / 100) * (1 - 1 / (1 << B)), self.hashes
        above = 0.0
        for k in range(n, 0, -1):
            above += math.comb(n, k) * q**k * (1 - q) ** (n - k)
            if above > MISSED:
                return k
        return 0


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are lower-cased (A-Z) runs between blanks; ``bytes`` methods know
    exactly these letters and blanks.
    """
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(s)]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union, the union not being empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Hashes:
    """K functions x -> (x ^ mask) * odd modulo 2**32, their minima, band keys and signatures."""

    def __init__(self, plan: Plan):
        self.plan = plan
        draw = np.random.default_rng(20240229)
        self.mask = draw.integers(0, 1 << 32, (plan.hashes, 1), dtype=np.uint32)
        self.odd = draw.integers(0, 1 << 31, (plan.hashes, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def minima(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.plan.hashes, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(out, ((x[None, i : i + 2048] ^ self.mask) * self.odd).min(axis=1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        m = minima.astype(np.uint64).reshape(self.plan.bands, self.plan.rows)
        key = np.arange(1, self.plan.bands + 1, dtype=np.uint64)
        for r in range(self.plan.rows):
            key = (key ^ m[:, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key.view(np.int64)

    def signature(self, minima: np.ndarray) -> bytes:
        m = (minima ^ (minima >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        low = ((m ^ (m >> np.uint32(13))) & np.uint32((1 << B) - 1)).astype(np.uint64)
        low = np.concatenate([low, np.zeros(-len(low) % LANES, dtype=np.uint64)]).reshape(-1, LANES)
        return np.bitwise_or.reduce(low << (np.arange(LANES, dtype=np.uint64) * np.uint64(B)), axis=1).tobytes()


def differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Lanes in which a signature differs from each of many (rows of 64-bit words), counted as bits."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def estimates(one: np.ndarray, many: np.ndarray, hashes: int) -> np.ndarray:
    """Estimated similarity of a signature to each of many: of unequal minima, 1 in 2**B agrees by chance, and is taken off."""
    chance = 1 / (1 << B)
    return (1 - differing(one, many) / hashes - chance) / (1 - chance)


def lanes_apart(a: str, c: str, words: int) -> Column:
    """``differing`` of two columns of signatures (arrays of longs)."""

    def one(k: int) -> Column:
        x = F.col(a)[k].bitwiseXOR(F.col(c)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(Column.__add__, map(one, range(words)))


SIGNED = "id long, text_key string, n_shingles long, digest binary, sig array<long>, bands array<long>"


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sign(docs: DataFrame, plan: Plan) -> DataFrame:
    """From (id, text_key, text): the size and digest of the shingle set, the packed signature and the band keys."""

    def run(batches):
        hashes = Hashes(plan)
        for batch in batches:
            n, digests, sigs, bands = [], [], [], []
            for text in each_text(batch.column(2)):
                s = shingles(text, plan.width)
                n.append(len(s))
                if not len(s):
                    digests.append(None), sigs.append(None), bands.append(None)
                    continue
                m = hashes.minima(s)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(np.frombuffer(hashes.signature(m), np.int64))
                bands.append(hashes.bands(m))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, longs), pa.array(bands, longs)],
                names=["id", "text_key", "n_shingles", "digest", "sig", "bands"],
            )

    return docs.mapInArrow(frugal(run), SIGNED)


def confirm(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """Of pairs (a, c), those whose full sets are linked: signatures are compared first, texts only of what these leave."""
    sigs = texts.select("node", "sig")
    likely = (
        pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("node").alias("c"), F.col("sig").alias("sig_c")), "c")
        .where(lanes_apart("sig_a", "sig_c", plan.words) <= plan.most_differ).select("a", "c")
    )
    joined = (
        likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("c"), F.col("text").alias("text_c")), "c")
        .select("a", "c", "text_a", "text_c")
    )

    def run(batches):
        last, center = None, None
        for batch in batches:
            keep = []
            for of_c, text_a, text_c in zip(batch.column(1).to_pylist(), each_text(batch.column(2)), each_text(batch.column(3))):
                if center is None or last != of_c:
                    last, center = of_c, shingles(text_c, plan.width)
                keep.append(linked(shingles(text_a, plan.width), center, plan.percent))
            yield batch.select(["a", "c"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(frugal(run), "a long, c long")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of an edge (a, c) reaches.

    Each round lets every vertex follow the first of itself and its neighbours,
    and goes on with the edges between those that were followed; an edge whose
    ends follow the same one is done. Two rounds by id, which is all that stars
    take, then one by a hash, so that the vertices of a long path fall by a
    fraction, and so on. Joins on a busy vertex can be split; minima are taken
    before rows move.
    """
    open_ = ws.save(edges.where("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while True:
        by_hash = len(rounds) % 3 == 2
        place = lambda v: F.struct(F.xxhash64(v, F.lit(len(rounds))).alias("h") if by_hash else F.lit(0).alias("h"), F.col(v).alias("v"))  # noqa: B023, E731
        both = open_.union(open_.select("c", "a"))
        led = both.groupBy("a").agg(F.min(place("c")).alias("least")).select(F.col("a").alias("id"), F.least("least", place("a"))["v"].alias("comp"))
        rounds.append(ws.save(led, "labels"))
        ends = [rounds[-1].select(F.col("id").alias(v), F.col("comp").alias(f"of_{v}")) for v in "ac"]
        left = open_.join(ends[0], "a").join(ends[1], "c").where("of_a <> of_c")
        left = ws.save(left.select(F.least("of_a", "of_c").alias("a"), F.greatest("of_a", "of_c").alias("c")).distinct(), "edges")
        ws.drop(open_)
        open_ = left
        if not open_.limit(1).count():
            break
    hashed, told = len(rounds) > 2, rounds.pop()
    while rounds:
        above = told.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        told = ws.save(rounds.pop().join(above, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "labels")
    if hashed:  # who is followed by all then needn't be the smallest
        told = ws.save(told.join(told.groupBy("comp").agg(F.min("id").alias("least")), "comp").select("id", F.col("least").alias("comp")), "labels")
    return told


class Forest:
    """Union-find over numbers; the smallest of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """False if they were one already."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def in_blocks(rows: DataFrame, group: str, block_rows: int, block_bytes: int | None, ws: Workspace) -> DataFrame:
    """Lays each group's (node, comp, ...) out for comparison of its components, block against block.

    The largest component's nodes (``main``) needn't be compared with each
    other, so blocks of the others meet each other (x <= y, kind 0) and blocks
    of the largest (x of theirs, y of the others; kind 1). Adds kind, x, y, side
    (only different sides are compared, unless x = y in kind 0). A group of n
    nodes of which s are outside its largest component makes s / block * n / block
    comparisons, each of a bounded size.
    """
    n_bytes = F.sum(F.octet_length("text")) if block_bytes else F.lit(0).cast("long")
    tally = ws.save(rows.groupBy(group, "comp").agg(F.count("*").alias("n"), n_bytes.alias("bytes")), "tally")
    sized = tally.groupBy(group).agg(
        F.max(F.struct("n", "comp", "bytes")).alias("largest"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("comps"),
    ).where("comps > 1")

    def blocks(n: Column, size: Column) -> Column:
        by_rows = F.ceil(n / block_rows)
        return F.greatest(by_rows, F.ceil(size / block_bytes)).cast("int") if block_bytes else by_rows.cast("int")

    sized = ws.save(
        sized.select(
            group, F.col("largest.comp").alias("main"), blocks(F.col("largest.n"), F.col("largest.bytes")).alias("main_blocks"),
            blocks(F.col("n") - F.col("largest.n"), F.col("bytes") - F.col("largest.bytes")).alias("blocks"),
        ),
        "sized",
    )
    is_main = F.col("comp") == F.col("main")
    placed = rows.join(sized, group).withColumn("block", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int"))
    kept = rows.columns
    mains = placed.where(is_main).select(*kept, F.lit(1).alias("kind"), F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(-1).alias("side"))
    others = placed.where(~is_main)
    against = others.select(*kept, F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("main_blocks") - 1)).alias("x"), F.col("block").alias("y"), F.lit(0).alias("side"))
    among = others.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *kept, F.lit(0).alias("kind"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("block").alias("side"),
    )
    key = [group, "kind", "x", "y"]
    return mains.unionByName(against).unionByName(among).select(*key, "side", *[c for c in kept if c != group]).repartition(*key).sortWithinPartitions(*key)


def runs_of_equal_keys(batches: Iterator[pa.RecordBatch], width: int = 4) -> Iterator[list]:
    """Each run of rows (side, node, comp, sig[, text]) behind equal first ``width`` values: arrays, signatures as rows of words, texts as a list."""
    key, held = None, []

    def whole():
        parts = list(zip(*held))
        return [*map(np.concatenate, parts[:4]), *([t for p in column for t in p.to_pylist()] for column in parts[4:])]

    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(width)], axis=1)
        side, node, comp = (batch.column(width + i).to_numpy() for i in range(3))
        words = batch.column(width + 3).flatten().to_numpy().reshape(len(batch), -1).view(np.uint64)
        texts = [batch.column(i) for i in range(width + 4, batch.num_columns)]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if (now := tuple(keys[a].tolist())) != key:
                if held:
                    yield whole()
                key, held = now, []
            held.append([side[a:b], node[a:b], comp[a:b], words[a:b], *(t.slice(a, b - a) for t in texts)])
    if held:
        yield whole()


def near_pairs(sides: np.ndarray, comps: np.ndarray, words: np.ndarray, plan: Plan) -> list[tuple[int, int, int]]:
    """(lanes apart, i, j) of the pairs of different components, and of different sides if there are such, that may be linked."""
    if (comps == comps[0]).all():
        return []
    across, out = (sides != sides[0]).any(), []
    for i in range(len(comps) - 1):
        ok = comps[i + 1 :] != comps[i]
        if across:
            ok &= sides[i + 1 :] != sides[i]
        if not ok.any():
            continue
        apart = differing(words[i], words[i + 1 :])
        at = np.flatnonzero(ok & (apart <= plan.most_differ))
        out += zip(apart[at].tolist(), [i] * len(at), (at + i + 1).tolist())
    return out


def as_edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "c"])


def suspects(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """From blocks of (side, node, comp, sig): each node that may be linked to another component's, with the smallest
    node that such pairs lead to. Fewer edges than a block has rows, and mostly the same ones from the buckets of one group."""
    for sides, nodes, comps, words in runs_of_equal_keys(batches):
        forest = Forest()
        for _, i, j in near_pairs(sides, comps, words, plan):
            forest.join(int(nodes[i]), int(nodes[j]))
        found = [(x, forest.find(x)) for x in forest.up]
        if any(x != y for x, y in found):
            yield as_edges([(x, y) for x, y in found if x != y])


def links_in_blocks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """From blocks of (side, node, comp, sig, text): linked pairs of components, nearest signatures first, none twice connected."""
    for sides, _, comps, words, texts in runs_of_equal_keys(batches):
        forest, out, named = Forest(), [], comps.tolist()
        sets: dict[int, np.ndarray] = {}
        for _, i, j in sorted(near_pairs(sides, comps, words, plan)):
            if forest.find(named[i]) == forest.find(named[j]):
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingles(texts[k], plan.width)
            if linked(sets[i], sets[j], plan.percent):
                forest.join(named[i], named[j])
                out.append((named[i], named[j]))
        if out:
            yield as_edges(out)


def grouped(docs: DataFrame, ws: Workspace, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """A row a row: id, text_key, n_shingles, group (null without shingles), component_id (the smallest id of the group, or of what shares the id)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    signed = ws.save(sign(source, plan), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key"))
    sets = signed.where("digest is not null").groupBy("digest").agg(first.alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # numbers of the written table: they don't change when a task runs again
    sets = ws.save(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "rep.id", "rep.text_key", "sig", "bands"), "sets")

    said = signed.select("id", "text_key", "n_shingles", "digest")
    of_set = said.where("digest is not null").join(sets.select("digest", "node", F.col("id").alias("least")), "digest").drop("digest")
    blank = said.where("digest is null").drop("digest").withColumns({"node": F.lit(None).cast("long"), "least": F.lit(None).cast("long")})
    members = ws.save(of_set.unionByName(blank), "members")
    ws.drop(signed)
    hubs = members.where("id is not null").groupBy("id").agg(
        F.min("node").alias("hub"), F.max("node").alias("top"), F.min("least").alias("hub_least"), F.count("*").alias("n"), F.count("node").alias("with_node")
    )
    hubs = ws.save(hubs.where("hub < top or n > with_node and with_node > 0").select("id", "hub", "hub_least"), "hubs")
    by_id = ws.save(members.where("node is not null").join(hubs, "id").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("c")).distinct(), "by-id")

    banded = sets.select("node", F.explode("bands").alias("bucket"))
    shared = (
        banded.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", F.xxhash64("node", "bucket")).alias("drawn"))
        .where("low < high")
        .select("bucket", "low", "drawn")
    )
    shared = ws.save(shared, "shared")
    cand = ws.save(banded.join(shared, "bucket").select("bucket", "node", "low", "drawn"), "candidates")
    wanted = sets.join(cand.select("node").distinct(), "node", "left_semi").select("node", "id", "text_key", "sig")
    # one text a node; equal rows of an id come together by the join, so that taking one of them moves nothing
    named = source.where("id is not null").join(wanted.where("id is not null"), ["id", "text_key"]).dropDuplicates(["id", "text_key"])
    nameless = source.where("id is null").select("text_key", "text").dropDuplicates(["text_key"]).join(wanted.where("id is null").drop("id"), "text_key")
    texts = ws.save(named.select("node", "sig", "text").unionByName(nameless.select("node", "sig", "text")), "texts")

    # a node's buckets mostly lead to one group: it is compared with the smallest node of all of them first, and with others only where that leaves the two apart
    leads = cand.where("node <> low").groupBy(F.col("node").alias("a")).agg(F.min("low").alias("c"))
    leads = ws.save(leads, "leads")
    led = ws.save(confirm(leads, texts, plan), "near")
    centres = leads.join(led.withColumn("linked", F.lit(True)), ["a", "c"], "left").select(F.col("a").alias("node"), F.col("c").alias("lead"), F.when(F.col("linked"), F.col("c")).alias("centre"))
    cand = ws.save(cand.join(centres, "node", "left").withColumn("centre", F.coalesce("centre", "node")), "led")
    of_low = cand.groupBy("bucket").agg(F.min_by("centre", "node").alias("low_centre"))
    tried = cand.join(of_low, "bucket").where("node <> low and centre <> low and centre <> low_centre").select("bucket", "node", "low", "drawn", "lead")
    tried = ws.save(tried, "tried")
    stars = ws.save(tried.where("low <> lead").select(F.col("node").alias("a"), F.col("low").alias("c")).distinct(), "stars")
    near = ws.save(confirm(stars, texts, plan), "near")
    apart = tried.join(near.select(F.col("a").alias("node"), F.col("c").alias("low")), ["node", "low"], "left_anti")
    near = led.union(near)
    more = ws.save(apart.where("node <> drawn and low <> drawn").select(F.least("node", "drawn").alias("a"), F.greatest("node", "drawn").alias("c")).distinct(), "more")
    more = ws.save(confirm(more, texts, plan), "near")
    comps = components(ws, near.union(more).union(by_id))

    placed = ws.save(cand.select("bucket", "node").join(comps, F.col("node") == F.col("id"), "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = ws.save(placed.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("bucket"), "mixed")
    open_ = ws.save(placed.join(mixed, "bucket").join(sets.select("node", "sig"), "node").select("bucket", "node", "comp", "sig"), "open")
    maybe = in_blocks(open_, "bucket", BLOCK, None, ws).mapInArrow(frugal(lambda rows: suspects(rows, plan)), "a long, c long")
    family = ws.save(components(ws, ws.save(maybe, "maybe")).withColumnRenamed("comp", "family"), "family")
    doubted = family.join(comps, "id", "left").select(F.col("id").alias("node"), "family", F.coalesce("comp", "id").alias("comp"))
    doubted = ws.save(doubted.join(texts, "node").select("family", "node", "comp", "sig", "text"), "doubted")
    late = in_blocks(doubted, "family", TEXT_BLOCK, TEXT_BYTES, ws).mapInArrow(frugal(lambda rows: links_in_blocks(rows, plan)), "a long, c long")
    joined = components(ws, ws.save(late, "late")).select(F.col("id").alias("comp"), F.col("comp").alias("last"))
    linked_nodes = comps.join(joined, "comp", "left").select(F.col("id").alias("node"), F.coalesce("last", "comp").alias("group"))
    alone = joined.join(comps, F.col("id") == joined["comp"], "left_anti").select(F.col("comp").alias("node"), F.col("last").alias("group"))
    final = ws.save(linked_nodes.union(alone), "final")
    least = final.join(sets.select("node", "id"), "node").groupBy("group").agg(F.min("id").alias("component_id"))
    final = ws.save(final.join(ws.save(least, "least"), "group"), "final")

    told = members.join(hubs, "id", "left").select(
        "id", "text_key", "n_shingles", F.coalesce("node", "hub").alias("node"), F.coalesce("least", "hub_least").alias("least")
    )
    return told.join(final, "node", "left").select(
        "id", "text_key", "n_shingles", F.coalesce("group", "node").alias("group"), F.coalesce("component_id", "least", "id").alias("component_id")
    )


def near_groups(docs: DataFrame, ws: Workspace, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a row: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept`` (it is that one)."""
    return grouped(docs, ws, plan, id_col, text_col).select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_copies(docs: DataFrame, ws: Workspace, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group, that of the smallest id.

    Of a group without any id the row with the least hash of its text stays; of
    several texts of a kept id that with words and the least hash, and of equal
    rows one. Rows without id and words belong to no group, and all stay.
    """
    told = ws.save(grouped(docs, ws, plan, id_col, text_col), "told")
    of_id = told.where("id = component_id").groupBy("id").agg(F.min(F.struct(F.col("n_shingles") == 0, "text_key")).alias("t")).select("id", "t.text_key")
    of_group = told.where("component_id is null and group is not null").groupBy("group").agg(F.min("text_key").alias("text_key")).select("text_key")
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(f"[^{BLANKS}]"), F.lit(False))
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text).alias("text_key"), worded.alias("worded"))
    named = rows.where("id is not null").join(of_id, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"])
    nameless = rows.where("id is null and worded").dropDuplicates(["text_key"]).join(of_group, "text_key", "left_semi")
    blank = rows.where("id is null and not worded")
    return named.select("row").union(nameless.select("row")).union(blank.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
