"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters of other scripts, digits
that stand for letters), so that a disguised word is the same string as the
plain one. An Aho-Corasick automaton finds the lexicon's words and word
beginnings in one pass; hits inside an exception phrase don't count. The sum of
the hits' weights over the text's length, calibrated on labels, is the score.

Cases: a null, empty or wordless text has no hit and gets the score of such
texts; repeated rows score alike; labels that are null are not learned from,
and a document with several labels is toxic if one says so; of several texts of
a labelled id that which sorts first is learned from; without any label
the lexicon is empty and the score is one half; other columns pass through.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe
from folioflow.llm.common import Workspace, bounded_sample, each_text, frugal

# Letters of other scripts, and digits and signs, by the letter they look like.
LOOK_ALIKES = {
    "a": "аα@4", "b": "вβ", "c": "сϲ", "d": "ԁ", "e": "еεё3", "h": "нһ", "i": "іιї1", "j": "ј", "k": "кκ",
    "m": "м", "n": "ոη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "s": "ѕ$5", "t": "тτ7", "u": "υ", "v": "ѵν",
    "w": "ԝω", "x": "хχ", "y": "уγү",
}
#: Bounds on what the lexicon is learned from: labelled rows of each class.
MAX_TOXIC, MAX_CLEAN = 4000, 12000
STEM_LENGTHS = (4, 5, 6, 7)
#: A text of so many words more is added to each length, so that one hit in a very short text isn't everything.
LENGTH_OFFSET = 20


class Folding(dict):
    """Translation of one character; i and l, which 1 can stand for, become one letter."""

    def __init__(self):
        super().__init__()
        for letter, others in LOOK_ALIKES.items():
            for c in letter + others:
                self[ord(c)] = letter
        for c in "il1":
            self[ord(c)] = "l"
        self[ord("і")] = self[ord("ι")] = self[ord("ї")] = "l"

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            if unicodedata.combining(c):
                continue
            if ord(c) != code and (ord(c) in self or ord(c) < 128):
                out += self[ord(c)]
            else:
                out += c if c.isalnum() else " "
        if len(self) < 200_000:
            self[code] = out
        return out


_FOLD = Folding()


def fold(text: str | None) -> str:
    """The text's words as folded letters, with single blanks around and between them."""
    return f" {' '.join((text or '').lower().translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Entries (" stem" or " word ") with weights, exception phrases (" a b "), and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    offset: float = 0.0
    floor: float = 0.002

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out

    def hits(self, folded: str, automaton) -> list[tuple[int, float]]:
        """Start and weight of each word that counts: of entries at one place, the heaviest."""
        found: dict[int, float] = {}
        spans = []
        if not len(automaton):
            return []
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        return [(s, w) for s, w in found.items() if not any(a <= s < b for a, b in spans)]

    def measure(self, text: str | None, automaton) -> tuple[int, int, float]:
        """Words, words that count, and the sum of their weights over the length."""
        folded = fold(text)
        words = max(0, folded.count(" ") - 1) if folded.strip() else 0
        hits = self.hits(folded, automaton)
        return words, len(hits), sum(w for _, w in hits) / (words + LENGTH_OFFSET)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * math.log(self.floor + density) + self.offset)))


def terms_of(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM_LENGTHS if len(w) >= n}


def count_terms(sample: DataFrame, wanted: frozenset | None) -> DataFrame:
    """(term, n): in how many texts of the sample each term is; a task sends its counts whenever it holds 200,000."""

    def told(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in each_text(batch.column(0)):
                terms = terms_of(fold(text))
                counts.update(terms if wanted is None else terms & wanted)
                if len(counts) > 200_000:
                    yield told(counts)
                    counts = Counter()
        yield told(counts)

    return sample.select("text").mapInArrow(frugal(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, labels: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: Sequence[str] = ()
) -> Lexicon:
    """Learns entries, exceptions and calibration from at most MAX_TOXIC and MAX_CLEAN labelled texts.

    The labelled rows are the first by a hash of their id, so the sample is the
    same on every run; its ids, few by that bound, are broadcast to the scan.
    Equal texts of one label count once. ``exceptions`` are phrases in which
    words of the lexicon are harmless, beside those that are learned.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    told = ws.save(told.select(F.col(id_col).alias("id"), "y"), "labels")
    ids = bounded_sample(told.where("y = 1"), ["id"], MAX_TOXIC).union(bounded_sample(told.where("y = 0"), ["id"], MAX_CLEAN))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # of rows that repeat an id the text that sorts first, so that there are no more rows than ids
    sample = source.join(F.broadcast(ids.select("id", "y")), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    sample = ws.save(sample.select("text", "y").distinct(), "sample")
    toxic, clean = sample.where("y = 1"), sample.where("y = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Lexicon(offset=0.0)

    least = max(3, math.ceil(0.004 * n_toxic))
    found = count_terms(toxic, None).where(F.col("n") >= least)
    in_toxic = {r.term: r.n for r in found.collect()}
    in_clean = {r.term: r.n for r in count_terms(clean, frozenset(in_toxic)).collect()}
    lexicon = Lexicon(weights=choose(in_toxic, in_clean, n_toxic, n_clean))
    lexicon.exceptions = [fold(p) for p in exceptions] + learn_exceptions(sample, lexicon)
    calibrate(lexicon, sample)
    return lexicon


def choose(in_toxic: dict[str, int], in_clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries by log odds of being in a toxic text; a longer entry stays out if a beginning of it says as much."""
    odds = {
        t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in in_toxic.items()
    }
    strong = {t: w for t, w in odds.items() if w >= 3.0 and in_clean.get(t, 0) <= 0.02 * in_toxic[t]}
    out: dict[str, float] = {}
    for t in sorted(strong, key=lambda t: (len(t), t)):
        shorter = [t[: n + 1] for n in STEM_LENGTHS if n + 1 < len(t)]
        if not any(out.get(s, 0.0) >= strong[t] - 0.7 for s in shorter):
            out[t] = strong[t]
    return {t: out[t] for t in sorted(out)}


def learn_exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Words, and pairs of words, that hold an entry but are in more clean than toxic texts (two clean ones at least)."""

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, phrases = fold(text), set()
                for start, _ in lexicon.hits(folded, automaton):
                    stop = folded.index(" ", start + 1)
                    before, after = folded.rfind(" ", 0, max(start, 0)), folded.find(" ", stop + 1)
                    phrases.add(folded[start : stop + 1])
                    phrases |= {folded[before : stop + 1]} if before >= 0 else set()
                    phrases |= {folded[start : after + 1]} if after >= 0 else set()
                counts.update((p, y) for p in phrases)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["phrase", "y", "n"],
            )

    seen = sample.mapInArrow(frugal(run), "phrase string, y int, n long")
    told = seen.groupBy("phrase").agg(F.sum(F.col("n") * (1 - F.col("y"))).alias("clean"), F.sum(F.col("n") * F.col("y")).alias("toxic"))
    return sorted(r.phrase for r in told.where("clean >= 2 and clean > toxic").collect())


def calibrate(lexicon: Lexicon, sample: DataFrame) -> None:
    """Logistic fit of the label on the log density, over the bounded sample; classes weigh alike."""
    rows = measure(sample, lexicon).select("y", "density").collect()
    x = np.log(lexicon.floor + np.array([r.density for r in rows]))
    y = np.array([r.y for r in rows], dtype=float)
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):  # Newton steps with a small ridge, as the classes may not overlap
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (weight * (p - y)) + 1e-4 * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        beta = beta - np.linalg.solve(hess, grad)
    lexicon.slope, lexicon.offset = float(beta[0]), float(beta[1])


def measure(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_hits, density and score to rows; one Arrow pass, no row moves."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hits", T.LongType()), T.StructField("density", T.DoubleType()), T.StructField("score", T.DoubleType())]
    schema = bpe.schema_with(df, added)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            told = [lexicon.measure(t, automaton) for t in each_text(batch.column(batch.schema.get_field_index(text_col)))]
            words, hits, density = zip(*told) if told else ((), (), ())
            yield bpe.with_columns(batch, {
                "n_words": pa.array(words, pa.int64()), "n_hits": pa.array(hits, pa.int64()),
                "density": pa.array(density, pa.float64()), "score": pa.array([lexicon.score(d) for d in density], pa.float64()),
            })

    return df.mapInArrow(frugal(run), schema)
