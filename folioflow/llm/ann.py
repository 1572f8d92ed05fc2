"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts; a
small classifier learns each vector's distribution over the parts of its
neighbours. Every vector is indexed in its most probable part; a query goes to
several of the most probable ones, as many as the sample needs for the recall
asked for, and what lies there is ranked by exact cosine in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part; vectors are compared with those of their length only; ties go to the
smaller id; of rows that repeat an id each is a candidate, except to a query of
that id, and each asks unless it is an equal row; rows without an id take no
part; with too few vectors for a sample there is one part and the search is
exact; an empty input gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import Workspace, bounded_sample, frugal

#: Vectors the partition is learned from, at most; neighbours in its graph; parts, at most.
MAX_SAMPLE, GRAPH_DEGREE, MAX_PARTS = 16000, 10, 160
#: Vectors, and queries, of a part that one run of rows compares.
BLOCK_ROWS = 8192
#: Share of the sample's true neighbours that the parts visited must hold.
RECALL = 0.95


@dataclass
class Router:
    """Softmax over one hidden layer; ``probes`` parts are searched for each query."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(unit), axis=1, kind="stable")


def neighbours(unit: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each row's k nearest others by cosine."""
    out = np.empty((len(unit), k), dtype=np.int64)
    for a in range(0, len(unit), 1024):
        s = unit[a : a + 1024] @ unit.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2.0
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.1) -> np.ndarray:
    """Cuts the graph into parts of about equal size.

    Medians along principal directions give equal parts; then vertices move, the
    most gaining first, to the part that holds most of their neighbours, as
    long as no part exceeds ``slack`` times its share.
    """
    label = np.zeros(len(unit), dtype=np.int64)
    groups = [np.arange(len(unit))]
    while len(groups) < parts:
        group = max(groups, key=len)
        groups = [g for g in groups if g is not group]
        x = unit[group] - unit[group].mean(axis=0)
        axis = np.linalg.svd(x.T @ x)[0][:, 0]
        order = np.argsort(x @ axis, kind="stable")
        groups += [group[order[: len(group) // 2]], group[order[len(group) // 2 :]]]
    for k, group in enumerate(groups):
        label[group] = k
    most = int(np.ceil(slack * len(unit) / parts))
    sizes = np.bincount(label, minlength=parts)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(unit)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(unit)), graph.shape[1])])], axis=1)
    for _ in range(sweeps):
        votes = np.zeros((len(unit), parts))
        np.add.at(votes, (both[0], label[both[1]]), 1.0)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(unit)), best] - votes[np.arange(len(unit)), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < most:
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


def train(unit: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Adam on the cross entropy with soft targets (a row's neighbours' parts)."""
    draw = np.random.default_rng(3)
    d, parts = unit.shape[1], target.shape[1]
    theta = [draw.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), draw.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = draw.permutation(len(unit))
        for a in range(0, len(unit), 256):
            x, y = unit[order[a : a + 256]], target[order[a : a + 256]]
            h = np.maximum(x @ theta[0] + theta[1], 0.0)
            z = h @ theta[2] + theta[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - y) / len(x)
            dh = (dz @ theta[2].T) * (h > 0)
            grads = [x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*theta)


def fit(vectors: np.ndarray, recall: float = RECALL, k: int = 5) -> Router:
    """Learns parts and router from sample vectors, and sets how many parts a query visits.

    A fifth of the sample isn't trained on; its true neighbours within the sample
    tell what share of them the first m parts hold. Too small a sample: one part.
    """
    n, d = vectors.shape if vectors.ndim == 2 else (0, 1)
    parts = min(MAX_PARTS, n // 100)
    if parts < 2:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    points = unit(vectors)
    graph = neighbours(points, min(GRAPH_DEGREE, n - 1))
    label = balanced_parts(points, graph, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(n), label] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    apart = np.arange(n) % 5 == 0
    router = train(points[~apart], target[~apart])
    home = router.ranked(points)[:, 0]
    asked = np.flatnonzero(apart)
    rank = np.argsort(router.ranked(points[asked]), axis=1)  # place of each part in the query's order
    places = rank[np.arange(len(asked))[:, None], home[neighbours(points, k)[asked]]]
    for m in range(1, parts + 1):
        router.probes = m
        if (places < m).mean() >= recall:
            break
    return router


def usable(vec: Column) -> Column:
    """True for a vector of finite components that isn't zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return F.coalesce(fine & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring the largest component near one: exact, and no square over- or underflows."""
    if not v.size:
        return v
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision; equal vectors give equal values."""
    q, v = scaled(q), scaled(v)
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[list, list, list]:
    """Each query's (its index) k best among the vectors, by exact cosine, ties to the smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    qn, vn = unit(q), unit(v)
    for a in range(0, len(q), 512):
        s = qn[a : a + 512] @ vn.T
        s[q_ids[a : a + 512, None] == ids[None, :]] = -np.inf
        cut = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        for i, least in enumerate(cut):
            at = np.flatnonzero(s[i] >= (least - 1e-9 if np.isfinite(least) else -2.0))
            exact = cosines(q[a + i][None, :], v[at])
            order = np.lexsort((ids[at], -exact))[:k]
            out[0].extend([a + i] * len(order)), out[1].extend(ids[at][order]), out[2].extend(exact[order])
    return out


def compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From rows (part, block, group, kind, id, mark, vec) sorted by the first four: each query's k best of each run.

    Queries (kind 0) come first and stay; vectors stream by.
    """
    place, q_ids, marks, q = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
    for batch in batches:
        part, block, group, kind, ids, mark = (batch.column(i).to_numpy() for i in range(6))
        vecs = matrix(batch.column(6))
        code = np.stack([part, block, group, kind], axis=1)
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1).tolist(), len(code)]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if place != (now := (part[a], block[a], group[a])):
                place, q_ids, marks, q = now, q_ids[:0], marks[:0], np.zeros((0, vecs.shape[1]))
            if kind[a] == 0:
                q_ids, marks, q = np.concatenate([q_ids, ids[a:b]]), np.concatenate([marks, mark[a:b]]), np.concatenate([q, vecs[a:b]])
            elif len(q_ids):
                at, *found = best_of(q_ids, q, ids[a:b], vecs[a:b], k)
                for mine, more in zip(out, (q_ids[at], marks[at], *found)):
                    mine.extend(more)
        kinds = {"query_id": pa.int64(), "mark": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds.values())], names=list(kinds))


def search(
    vectors: DataFrame, ws: Workspace, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    Vectors of one length are searched together, those of each other length
    (there is one, as a rule) by themselves.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    valid = source.where(usable(F.col("vec")))
    lengths = [r.n for r in valid.where(F.col("id") % every == 0).select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    found = [search_length(valid.where(F.size("vec") == n), ws, every, k, recall) for n in lengths]
    empty = ws.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def search_length(valid: DataFrame, ws: Workspace, every: int, k: int, recall: float) -> DataFrame:
    """``search`` among usable vectors (id, vec) of one length.

    A part is compared in blocks of at most about BLOCK_ROWS vectors and as many
    queries, so that one part with a third of all rows is the work of many
    tasks. Of each run k rows a query leave a task, and the k best of a task.
    A query that finds fewer than k in its parts is sent to all.
    """
    spark = ws.spark
    sample = bounded_sample(valid, ["id"], MAX_SAMPLE).select("vec").collect()
    router = fit(np.array([r.vec for r in sample], dtype=float), recall, k)
    shared = spark.sparkContext.broadcast(router)  # bounded by the layer sizes

    def route(batches):
        r = shared.value
        for batch in batches:
            v = matrix(batch.column(1))
            ranked = r.ranked(unit(v))[:, : r.probes] if len(v) else np.zeros((0, 1), dtype=int)
            parts = pa.array(ranked.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], names=["id", "vec", "parts"])

    routed = ws.save(valid.mapInArrow(frugal(route), "id long, vec array<double>, parts array<int>"), "routed")
    # rows that repeat an id with another vector ask for themselves; equal rows ask once
    asked = routed.where(F.col("id") % every == 0).withColumn("mark", F.xxhash64("vec")).dropDuplicates(["id", "mark"])
    asked = ws.save(asked, "asked")
    homes = {r.part: r["count"] for r in routed.groupBy(F.element_at("parts", 1).alias("part")).count().collect()}  # a row a part

    def nearest(queries: DataFrame) -> DataFrame:
        """The k best of (id, mark, vec, parts) in the parts named."""
        asks = {r.part: r["count"] for r in queries.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}

        def pieces(counts: dict[int, int]) -> Column:
            return F.element_at(F.create_map(*[F.lit(int(x)) for p in range(router.parts) for x in (p, -(-counts.get(p, 1) // BLOCK_ROWS))]), F.col("part"))

        def each(n: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), n - 1))

        def drawn(n: Column) -> Column:
            return F.pmod(F.xxhash64("id", "vec"), n).cast("int")

        no_mark = F.lit(0).cast("long").alias("mark")
        held = routed.select("id", "vec", F.element_at("parts", 1).alias("part"), F.lit(1).alias("kind"), no_mark)
        held = held.withColumn("block", drawn(pieces(homes))).withColumn("group", each(pieces(asks)))
        sent = queries.select("id", "vec", "mark", F.explode("parts").alias("part"), F.lit(0).alias("kind"))
        sent = sent.withColumn("group", drawn(pieces(asks))).withColumn("block", each(pieces(homes)))
        keys = ["part", "block", "group"]
        mixed = held.unionByName(sent).select(*keys, "kind", "id", "mark", "vec").repartition(*keys).sortWithinPartitions(*keys, "kind")
        near = mixed.mapInArrow(frugal(lambda rows: compare(rows, k)), "query_id long, mark long, vec_id long, score double")
        # the k best of each task go on, and of these the k best
        first = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    found = ws.save(nearest(asked), "found")
    counts = found.groupBy(F.col("query_id").alias("id"), "mark").agg(F.count("*").alias("n"))
    short = asked.join(counts, ["id", "mark"], "left").where(F.coalesce("n", F.lit(0)) < k)
    short = ws.save(short.withColumn("parts", F.sequence(F.lit(0), F.lit(router.parts - 1))).select("id", "mark", "vec", "parts"), "short")
    if router.probes < router.parts and short.limit(1).count():
        kept = found.join(short.select(F.col("id").alias("query_id"), "mark"), ["query_id", "mark"], "left_anti")
        found = kept.unionByName(ws.save(nearest(short), "more"))
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
