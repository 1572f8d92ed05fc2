"""Quality by ordinal (cumulative-link) regression on graded ratings.

One weight vector over hashed words and shape features is shared by all grades;
ordered thresholds cut its score: P(grade > g_k) = sigmoid(w.x - t_k). The
expected grade ranks documents, and a tail probability selects them.

Cases: a null or empty text has the features of an empty one; rows without a
rating aren't learned from, and of several ratings or texts of a document the
lowest and that which sorts first count; with fewer than two grades every document gets the only grade (0 if
there is none) and is kept; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe
from folioflow.llm.common import Workspace, bounded_sample, each_text, frugal
from folioflow.llm.features import word_counts

WORD_BINS = 1 << 16
#: Buckets of each shape feature, as upper bounds.
SHAPES = {
    "words": (0, 1, 5, 20, 50, 100, 500),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "new_trigrams": (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.98),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "symbols": (0.0, 0.005, 0.01, 0.03, 0.1, 0.3),
    "digits": (0.0, 0.01, 0.05, 0.2),
    "lines": (0.0, 0.1, 0.3, 0.5),
}
BINS = WORD_BINS + sum(len(b) + 1 for b in SHAPES.values())
#: Rated rows that the model is fitted on, at most.
MAX_RATED = 12000

_BYTES = np.zeros(256, dtype=np.int8)
_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_BYTES[np.frombuffer(b"0123456789", np.uint8)] = 2
_BYTES[np.frombuffer(b"#*$%&|<>!{}[]=~^_@\\/+", np.uint8)] = 3


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: damped word counts to unit length, and a one for the bucket of each shape feature."""
    data = (text or "").encode()
    words = data.split()
    at, counts = word_counts([w.lower() for w in words], WORD_BINS)
    values = np.log1p(counts)
    values = values / max(1e-12, float(np.sqrt(values @ values)))
    n, size = len(words), max(1, len(data))
    kinds = np.bincount(_BYTES[np.frombuffer(data, np.uint8)], minlength=4)
    lines = [x for x in data.split(b"\n") if x.strip()]
    told = {
        "words": n,
        "distinct": len(set(words)) / max(1, n),
        "new_trigrams": len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
        "upper": kinds[1] / size,
        "symbols": kinds[3] / size,
        "digits": kinds[2] / size,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    slots, start = [], WORD_BINS
    for name, bounds in SHAPES.items():
        slots.append(start + int(np.searchsorted(bounds, told[name])))
        start += len(bounds) + 1
    return np.concatenate([at, slots]), np.concatenate([values, np.ones(len(slots))])


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > g_k) for each grade but the last."""
        at, values = features(text)
        return 1 / (1 + np.exp(-np.clip(values @ self.weights[at] - self.thresholds, -40, 40)))

    def expected(self, tails: np.ndarray) -> float:
        return float(self.grades[0] + np.diff(self.grades) @ tails)


def fit(data: list[tuple[np.ndarray, np.ndarray, int]], grades: list[float], rate: float = 0.3, l2: float = 1e-5, epochs: int = 6) -> Model:
    """Adaptive gradient steps on the likelihood; rows are in the order of a fixed seed.

    The thresholds start at the grades' log odds and are kept in order by sorting.
    """
    k = len(grades) - 1
    y = np.array([d[2] for d in data])
    least = min(1e-3, 0.5 / len(y))  # so that no two thresholds start as one
    share = np.array([(y > j).mean() for j in range(k)]).clip(least, 1 - least)
    w, gw = np.zeros(BINS), np.full(BINS, 1e-6)
    t, gt = np.sort(-np.log(share / (1 - share))), np.full(k, 1e-6)
    draw = np.random.default_rng(11)
    for _ in range(epochs):
        for i in draw.permutation(len(data)):
            at, values, grade = data[i]
            values = values.astype(float)
            s = values @ w[at]
            p = 1 / (1 + np.exp(-np.clip(s - np.concatenate([[-np.inf], t, [np.inf]]), -500, 500)))  # P(> g) with both ends
            p[0], p[-1] = 1.0, 0.0
            d = p * (1 - p)
            q = max(p[grade] - p[grade + 1], 1e-9)
            g = -(d[grade] - d[grade + 1]) / q
            grad = g * values + l2 * w[at]
            gw[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(gw[at])
            dt = np.zeros(k)
            if grade > 0:
                dt[grade - 1] += d[grade] / q
            if grade < k:
                dt[grade] -= d[grade + 1] / q
            gt += dt * dt
            t = np.sort(t - rate * dt / np.sqrt(gt))
    return Model(grades, w, t)


def learn(docs: DataFrame, ratings: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality") -> Model:
    """Fits on at most MAX_RATED rated texts, the first by a hash of their id (few ids, broadcast to the scan). Each distinct rating is a grade."""
    told = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(grade_col).cast("double")).alias("grade"))
    ids = bounded_sample(told, ["id"], MAX_RATED).withColumn("h", F.xxhash64("id"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [features(t) for t in each_text(batch.column(0))]
            packed = [pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in enumerate(("<i4", "<f4"))]
            yield pa.RecordBatch.from_arrays([*packed, batch.column(1), batch.column(2)], names=["at", "value", "grade", "h"])

    # of rows that repeat an id the text that sorts first, so that there are no more rows than ids
    rated = source.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"), F.first("h").alias("h"))
    rows = rated.select("text", "grade", "h").mapInArrow(frugal(run), "at binary, value binary, grade double, h long")
    # as bytes: lists of Python's numbers would take ten times as much of the driver's memory
    rows = sorted(rows.toLocalIterator(), key=lambda r: (r.h, r.grade))
    grades = sorted({r.grade for r in rows})
    if len(grades) < 2:
        return Model(grades or [0.0], np.zeros(BINS), np.zeros(0))
    place = {g: i for i, g in enumerate(grades)}
    return fit([(np.frombuffer(r.at, "<i4"), np.frombuffer(r.value, "<f4"), place[r.grade]) for r in rows], grades)


def grade(docs: DataFrame, model: Model, least: float | None = None, text_col: str = "text", min_tail: float = 0.5) -> DataFrame:
    """Adds expected_grade, tail (P(grade >= least); the top grade if None) and selected (tail >= min_tail)."""
    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("selected", T.BooleanType())]
    schema = bpe.schema_with(docs, added)
    want = model.grades[-1] if least is None else least
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers

    def run(batches):
        m = shared.value
        k = sum(g < want for g in m.grades)
        for batch in batches:
            expected, tail = [], []
            for text in each_text(batch.column(batch.schema.get_field_index(text_col))):
                p = m.tails(text)
                expected.append(m.expected(p))
                tail.append(1.0 if k == 0 or len(m.grades) < 2 else float(p[k - 1]) if k <= len(p) else 0.0)
            yield bpe.with_columns(batch, {
                "expected_grade": pa.array(expected, pa.float64()), "tail": pa.array(tail, pa.float64()),
                "selected": pa.array([x >= min_tail for x in tail], pa.bool_()),
            })

    return docs.mapInArrow(frugal(run), schema)
