"""Content-addressed store for token-id streams.

Each document's ids are cut into chunks where a rolling hash of the last few
ids says so, so equal passages give equal chunks wherever they stand. A store
is a folder of three Parquet tables:

``chunks``    digest (binary), n_ids, width (2 or 4), payload: the ids as
              little-endian unsigned integers of ``width`` bytes. Every digest
              is there once.
``recipes``   in ascending doc_id order: row (0, 1, ...), doc_id, start (ids
              of all rows before), n_tokens, digests (the chunks in turn), root
              (Merkle root of the digests), segment.
``manifest``  one row a segment of the recipes: first row, rows, ids, and the
              Merkle root of the recipes' roots.

Cases: a null or empty text has the end id alone; strings of special tokens
are taken as the tokenizer file has them; repeated rows get a recipe each; a null doc_id sorts first; other columns of the input are not stored; an
empty input gives empty tables.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe
from folioflow.llm.common import Workspace, frugal, shuffle_parts

#: A chunk ends where the hash of the last WINDOW ids has MASK's bits clear, or at MAX_IDS.
WINDOW, MASK, MIN_IDS, MAX_IDS = 8, 0x1FF, 64, 4096
DIGEST_BYTES = 16
#: Digests that a task remembers having sent; beyond, copies are dropped where they arrive.
SENT = 500_000


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node goes up as it is. No leaves: the digest of nothing."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        paired = [digest(b"\x01" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0]


def rolling_cuts(ids: np.ndarray) -> np.ndarray:
    """Positions (ends, exclusive) where the hash of the WINDOW ids before allows a cut.

    The hash is the sum of the window's ids, each mixed, times powers of an odd
    number modulo 2**32: a polynomial hash, here taken at all positions at once.
    """
    if len(ids) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    h, span, power = x, 1, 0x01000193  # hashes of 1, 2, 4, ... ids; WINDOW is a power of two
    while span < WINDOW:
        h = h[:-span] * np.uint32(power) + h[span:]
        span, power = 2 * span, power * power % (1 << 32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return np.flatnonzero((h & np.uint32(MASK)) == 0) + WINDOW


def chunk_ends(cuts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all documents' chunks, and how many each document has.

    ``bounds``: where each document's ids begin, and the end of the last. Only
    cuts whose whole window lies within a document count; none makes a chunk
    shorter than MIN_IDS, and a chunk without a cut ends at MAX_IDS.
    """
    ends, counts = [], []
    first = np.searchsorted(cuts, bounds[:-1] + WINDOW).tolist()
    last = np.searchsorted(cuts, bounds[1:], side="right").tolist()
    cuts, bounds = cuts.tolist(), bounds.tolist()
    for at, end, a, b in zip(bounds, bounds[1:], first, last):
        before = len(ends)
        for stop in [*cuts[a:b], end]:
            while stop - at > MAX_IDS:
                at += MAX_IDS
                ends.append(at)
            if stop - at >= MIN_IDS or stop == end > at:
                at = stop
                ends.append(at)
        counts.append(len(ends) - before)
    return np.array(ends, dtype=np.int64), np.array(counts, dtype=np.int64)


_ZEROS = memoryview(bytes(4 * MAX_IDS))


def join_crcs(parts: Iterable[tuple[int, int]]) -> int:
    """crc32 of joined byte strings, from the crc32 and length (up to that of a chunk) of each.

    The crc32 of B after A differs from that of as many zeros after A by what
    B's own differs from that of the zeros.
    """
    out = 0
    for crc, length in parts:
        zeros = _ZEROS[:length]
        out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros) ^ crc
    return out


def write_store(
    docs: DataFrame, ws: Workspace, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> dict[str, str]:
    """Encodes ``docs`` with the tokenizer file ``path`` and writes a store; returns the tables' paths.

    Texts are read and encoded once, where they lie. Only chunks move, to the
    task that sorts their digest and keeps the first of equal neighbours; each
    task sends a digest once, so a passage that a third of all documents share
    arrives a few times only. Recipes are dealt evenly with them.
    """
    spark = ws.spark
    def cut(batches):
        enc = bpe.encoder(path)
        width = 2 if len(enc.table) <= 1 << 16 and end_id < 1 << 16 else 4
        sent: set[bytes] = set()
        for batch in batches:
            for a, b in bpe.text_slices(batch.column(1)):
                flat, bounds = enc.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(flat, bounds[1:], end_id).astype(f"<u{width}")
                bounds = bounds + np.arange(b - a + 1)
                ends, counts = chunk_ends(rolling_cuts(ids), bounds)
                # the chunks tile the ids, so their payloads are one buffer with the chunks' ends as offsets
                starts, raw = np.concatenate([[0], ends]), memoryview(ids.tobytes())
                names = [digest(raw[width * x : width * y]) for x, y in itertools.pairwise(starts.tolist())]
                offsets = pa.py_buffer((starts * width).astype(np.int32).tobytes())
                payload = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, offsets, pa.py_buffer(raw)])
                new = []
                for name in names:
                    new.append(name not in sent)
                    if new[-1] and len(sent) < SENT:
                        sent.add(name)
                digests, mine = pa.array(names, pa.binary()), pa.array(new, pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), digests)
                yield rows_of(b - a, doc_id=batch.column(0).slice(a, b - a), n_tokens=pa.array(np.diff(bounds)), digests=lists)
                yield rows_of(
                    sum(new), digest=digests.filter(mine), n_ids=pa.array(np.diff(starts).astype(np.int32)).filter(mine),
                    width=pa.repeat(pa.scalar(width, pa.int32()), sum(new)), payload=payload.filter(mine),
                )

    kinds = {
        "doc_id": pa.int64(), "n_tokens": pa.int64(), "digests": pa.list_(pa.binary()),
        "digest": pa.binary(), "n_ids": pa.int32(), "width": pa.int32(), "payload": pa.binary(),
    }

    def rows_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    schema = "doc_id long, n_tokens long, digests array<binary>, digest binary, n_ids int, width int, payload binary"

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a recipe's key is its place in the scan, the same each time that a task runs
    key = F.coalesce("digest", F.monotonically_increasing_id().cast("string").cast("binary"))
    unique = (
        source.mapInArrow(frugal(cut), schema).withColumn("key", key)
        .withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key")))  # copies are neighbours in sorted order
        .where("digest is null or copy = 1").drop("key", "copy")
    )
    loose = ws.path("loose")
    (
        unique.withColumn("kind", F.when(F.col("digest").isNull(), "recipe").otherwise("chunk"))
        .write.partitionBy("kind").option("compression", "zstd").parquet(loose)
    )
    for kind in ("chunk", "recipe"):
        if not ws.exists(f"{loose}/kind={kind}"):  # without rows there is no folder
            unique.limit(0).write.parquet(f"{loose}/kind={kind}")
    both = spark.read.schema(unique.schema.add("kind", "string")).parquet(loose)
    chunks = both.where("kind = 'chunk'").select("digest", "n_ids", "width", "payload")
    recipes = both.where("kind = 'recipe'").select("doc_id", "n_tokens", "digests")

    segments = max(1, shuffle_parts(spark))
    ordered = ws.save(
        recipes.repartitionByRange(segments, F.col("doc_id").asc_nulls_first(), F.xxhash64("digests"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digests")
        .withColumn("segment", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
        "ordered",
    )
    sums = ordered.groupBy("segment").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # one row a segment, of which there are as many as shuffle partitions
    sums = sums.select(
        "segment", "n_rows", "n_ids",
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row"),
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"),
    )
    upto = Window.partitionBy("segment").orderBy("at")
    placed = ordered.join(F.broadcast(sums), "segment").select(
        (F.col("first_row") + F.row_number().over(upto) - 1).alias("row"),
        "doc_id",
        (F.col("first_id") + F.sum("n_tokens").over(upto) - F.col("n_tokens")).alias("start"),
        "n_tokens", "digests", "segment", "at",
    )
    rooted = placed.withColumn("root", _root_of(F.col("digests"))).drop("at")
    paths = {"chunks": f"{loose}/kind=chunk", "recipes": ws.path("recipes"), "manifest": ws.path("manifest")}
    rooted.write.parquet(paths["recipes"])
    manifest_of(ws.read(paths["recipes"], rooted.schema)).write.parquet(paths["manifest"])
    ws.drop(ordered)
    return paths


@F.pandas_udf(T.BinaryType())
def _root_of(lists):
    return lists.map(lambda x: merkle_root([bytes(d) for d in x]))


def manifest_of(recipes: DataFrame) -> DataFrame:
    """A row a segment: where it begins, its size, and the Merkle root of its recipes' roots.

    The roots of a segment are hashed in blocks of 1024 rows and then again, so
    that no task holds more than the block roots of one segment.
    """
    blocks = recipes.groupBy("segment", F.floor(F.col("row") / 1024).alias("block")).agg(
        F.min("row").alias("first_row"), F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_ids"),
        F.array_sort(F.collect_list(F.struct("row", "root"))).alias("roots"),
    ).withColumn("root", _root_of(F.col("roots.root")))
    return blocks.groupBy("segment").agg(
        F.min("first_row").alias("first_row"), F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"),
        F.array_sort(F.collect_list(F.struct("first_row", "root"))).alias("roots"),
    ).withColumn("root", _root_of(F.col("roots.root"))).drop("roots")


RECIPES = "row long, doc_id long, start long, n_tokens long, digests array<binary>, segment int, root binary"
CHUNKS = "digest binary, n_ids int, width int, payload binary"
MANIFEST = "segment int, first_row long, n_rows long, n_ids long, root binary"


def read_checks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Reads a store back: a row a recipe with ids_crc32 and whether all its hashes hold.

    Each payload is read where it lies and reduced to its digest, length and
    crc32 (of the ids as unsigned 32-bit integers); only these move. The crc32
    of a document is joined from those of its chunks, which is exact.
    """
    recipes = spark.read.schema(RECIPES).parquet(paths["recipes"])
    chunks = spark.read.schema(CHUNKS).parquet(paths["chunks"])
    manifest = spark.read.schema(MANIFEST).parquet(paths["manifest"])

    def reduce(batches):
        for batch in batches:
            crcs, right = [], []
            for name, n, width, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(payload, dtype=f"<u{width}")
                right.append(len(ids) == n and digest(payload) == name)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), pa.array(right, pa.bool_())],
                names=["digest", "n_ids", "crc", "right"],
            )

    facts = chunks.mapInArrow(frugal(reduce), "digest binary, n_ids int, crc long, right boolean")
    uses = recipes.select("row", F.posexplode("digests").alias("seq", "digest"))
    told = uses.join(facts, "digest", "left").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("seq", "digest", "n_ids", "crc", "right"))).alias("parts")
    )

    def fold(batches):
        for batch in batches:
            lists, roots = batch.column(4), batch.column(5).to_pylist()
            flat = lists.flatten()
            names, sizes, crcs, fine = (flat.field(i).to_pylist() for i in range(1, 5))
            bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            out, sums, right = [], [], []
            for a, b, root in zip(bounds, bounds[1:], roots):
                whole = None not in crcs[a:b]
                out.append(join_crcs((c, 4 * n) for c, n in zip(crcs[a:b], sizes[a:b])) if whole else None)
                sums.append(sum(sizes[a:b]) if whole else None)
                right.append(whole and all(fine[a:b]) and merkle_root(names[a:b]) == root)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(sums, pa.int64()), pa.array(out, pa.int64()), pa.array(right, pa.bool_())],
                names=["row", "doc_id", "start", "segment", "n_tokens", "ids_crc32", "verified"],
            )

    joined = recipes.join(told, "row").select("row", "doc_id", "start", "segment", "parts", "root")
    out = joined.mapInArrow(frugal(fold), "row long, doc_id long, start long, segment int, n_tokens long, ids_crc32 long, verified boolean")
    again = manifest_of(recipes).select("segment", F.col("root").alias("root_now"))
    sound = manifest.join(again, "segment", "left").select("segment", F.coalesce(F.col("root") == F.col("root_now"), F.lit(False)).alias("sound"))
    return out.join(sound, "segment", "left").select(
        "row", "doc_id", "start", "n_tokens", "ids_crc32", (F.col("verified") & F.coalesce("sound", F.lit(False))).alias("verified")
    )


def read_ids(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Reads whole id lists back: row, doc_id, ids. Payloads move to their documents."""
    recipes = spark.read.schema(RECIPES).parquet(paths["recipes"])
    chunks = spark.read.schema(CHUNKS).parquet(paths["chunks"])
    uses = recipes.select("row", "doc_id", F.posexplode("digests").alias("seq", "digest"))
    lists = uses.join(chunks, "digest").groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "width", "payload"))).alias("parts")
    )

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def unpack(parts):
        return parts.map(lambda ps: np.concatenate([np.frombuffer(p["payload"], f"<u{p['width']}") for p in ps]).astype(np.int64))

    return lists.select("row", "doc_id", unpack("parts").alias("ids"))
