"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all training texts. The weights are learned with
follow-the-regularised-leader (proximal, per coordinate) under an elastic net,
on a bounded sample with every language alike; a temperature fitted on a part
of the sample kept apart turns scores into probabilities.

Cases: texts that are null or have no letter get ``und`` with score 0; with one
language learned it is always the answer, with score 1; with none it is ``und``;
ties go to the language that sorts first; rows that repeat count each; more than
MAX_LANGUAGES languages are an error; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe
from folioflow.llm.common import Workspace, each_text, frugal
from folioflow.llm.features import has_letter, letters, ngram_counts

ORDERS, BINS = (1, 2, 3), 1 << 15
#: Bounds on the sample that weights are learned from.
MAX_PER_LANGUAGE, MAX_SAMPLE = 800, 16000
#: Languages that a model may have (its weights are BINS numbers a language); more are refused.
MAX_LANGUAGES = 2000
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BINS + 1 rows (the last is the bias), a column a language
    temperature: float = 1.0

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        at, values = vector(ngram_counts(letters(text), ORDERS, BINS), self.idf)
        z = (values @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of (1 + log tf) * idf, to unit length."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / max(1e-12, float(np.sqrt(values @ values)))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and texts with each hashed n-gram, over all rows. Sums of BINS numbers a task move."""

    def run(batches):
        total, n = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for text in each_text(batch.column(0)):
                if has_letter(text):
                    total += ngram_counts(letters(text), ORDERS, BINS) > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bin", "n"])

    df = np.zeros(BINS, dtype=np.int64)
    n = 0
    for row in texts.mapInArrow(frugal(run), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS + 1 rows at most
        if row.bin < 0:
            n = row.n
        else:
            df[row.bin] = row.n
    return n, df


def ftrl(
    data: list[tuple[np.ndarray, np.ndarray, int]], classes: int, bins: int, rate: float = 0.5, beta: float = 1.0,
    l1: float = 0.3, l2: float = 0.05, epochs: int = 3,
) -> np.ndarray:
    """FTRL-proximal for a softmax over sparse rows (slots, values, class)."""
    z = np.zeros((bins + 1, classes))
    n = np.zeros((bins + 1, classes))

    def current(zs, ns):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(ns)) / rate + l2)

    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for k in draw.permutation(len(data)):
            at, values, y = data[k]
            at, values = np.append(at, bins), np.append(values, 1.0)
            zs, ns = z[at], n[at]
            w = current(zs, ns)
            s = values @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = values[:, None] * p[None, :]
            n_new = ns + g * g
            z[at] = zs + g - (np.sqrt(n_new) - np.sqrt(ns)) / rate * w
            n[at] = n_new
    return current(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature in [0.02, 20] of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def learn(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows whose language isn't null; the caller leaves out what is held out."""
    told = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(lang_col)).alias("h"))
    counts = {r.lang: r["count"] for r in told.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is {lang_col} a language code?")
    n, df = document_frequencies(told.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, idf, np.zeros((BINS + 1, len(languages))))
    each = max(20, min(MAX_PER_LANGUAGE, MAX_SAMPLE // len(languages)))
    parts = {lang: min(1.0, each / c) for lang, c in counts.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for item in parts.items() for x in item]), F.col("lang"))
    chosen = told.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def run(batches):
        for batch in batches:
            ats, values, langs, hs = [], [], [], []
            for text, lang, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if has_letter(text):
                    at, value = vector(ngram_counts(letters(text), ORDERS, BINS), idf)
                    ats.append(at), values.append(value.astype(np.float32)), langs.append(lang), hs.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs, pa.int64()), pa.array(langs, pa.string()), pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=["h", "lang", "at", "value"],
            )

    rows = chosen.mapInArrow(frugal(run), "h long, lang string, at array<int>, value array<float>").orderBy("h", "lang").limit(2 * MAX_SAMPLE)
    data = [(np.array(r.at), np.array(r.value, dtype=float), languages.index(r.lang)) for r in rows.toLocalIterator()]
    apart, rest = data[::5], [d for i, d in enumerate(data) if i % 5]
    weights = ftrl(rest, len(languages), BINS)
    logits = np.array([v @ weights[at] + weights[-1] for at, v, _ in apart]).reshape(-1, len(languages))
    return Model(languages, idf, weights, fit_temperature(logits, np.array([y for *_, y in apart], dtype=int)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the answer's probability)."""
    schema = bpe.schema_with(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS + 1 rows by the languages learned

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in each_text(batch.column(batch.schema.get_field_index(text_col))):
                if not m.languages or not has_letter(text):
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                p = m.scores(text)
                langs.append(m.languages[int(p.argmax())]), scores.append(float(p.max()))
            yield bpe.with_columns(batch, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(frugal(run), schema)
