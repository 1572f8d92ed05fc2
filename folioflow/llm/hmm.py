"""A hidden Markov language model.

Words are counted over the whole training corpus. The commonest SYMBOLS words
are symbols of the model; every other word is a symbol by a hash of its ending,
and within such a class has its share of the class's counts, so that the model
gives each word its own probability. States are learned by Baum-Welch: expected
counts of each task's texts are summed across tasks, pass after pass, until the
likelihood of the whole corpus settles. The scaled forward recursion gives a
whole text's exact likelihood.

Cases: a null or empty text is the end token alone; a word never seen in
training shares its class's one spare place; rows without an id are trained on,
as they can't be held out; repeated rows count each; without training texts
every score is that of the add-one estimate; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Workspace, bounded_sample, frugal

#: Words that are symbols themselves; classes of the others; hidden states.
SYMBOLS, CLASSES, STATES = 8000, 64, 8
#: Words whose counts every worker knows (at most so many, of at most so many bytes); the others are joined.
COMMON, COMMON_BYTES = 150_000, 64
#: Texts and rounds that the first model comes from, before the passes over the whole corpus.
SEED_TEXTS, SEED_ROUNDS = 1000, 3
#: Passes end when one raises the corpus's log likelihood by less than this share of it.
SETTLED = 1e-4
#: Tokens whose forward vectors are held at a time.
HELD = 300_000
#: Weight, in tokens, of the corpus frequencies within each state's emissions.
PRIOR = 200.0


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``words_of`` for a column: the text and the code of each word, and the distinct words (binary) by code."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    coded = parts.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
    said = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[codes]  # blanks at the ends split off nothing
    return doc[said], codes[said], words


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_of`` each word."""
    tails = pc.binary_slice(words, -2).dictionary_encode()
    by_tail = np.array([class_of(t) for t in tails.dictionary.to_pylist()], dtype=np.int64)
    return by_tail[tails.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.int64)


@dataclass
class Counts:
    """What training texts hold: counts of common words, commonest first, and totals.

    The first ``n_symbols`` common words are symbols 1, 2, ...; 0 is the end;
    classes follow. ``log_class``: log10 of each class's total and spare place.
    """

    tokens: int
    distinct: int
    ends: int
    common: pa.Array
    common_counts: np.ndarray
    n_symbols: int
    symbol_counts: np.ndarray
    log_class: np.ndarray
    table: DataFrame | None = None


def count_words(texts: DataFrame, ws: Workspace) -> Counts:
    """Counts over all of ``texts`` (one column). A task sends its counts whenever it holds 400,000; the table is written."""

    def told(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            _, codes, words = coded_words(batch.column(0))
            times = np.bincount(codes, minlength=len(words)).tolist()
            for word, n in zip(words.to_pylist(), times):
                if n:
                    counts[word] += n
            if len(counts) > 400_000:
                yield told(counts)
                counts = Counter()
        yield told(counts)

    ends = texts.count()
    table = ws.save(texts.mapInArrow(frugal(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    group = F.crc32(F.expr("substring(word, -2, 2)")) % CLASSES
    classes = {int(r.g): (int(r.n), int(r.c)) for r in table.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    top = most_common(table.where(F.octet_length("word") <= COMMON_BYTES))
    common, common_counts = [w for w, _ in top], np.array([c for _, c in top], dtype=np.int64)
    n_symbols = min(SYMBOLS, len(common))
    words, total = np.zeros(CLASSES), np.zeros(CLASSES)
    for g, (n, c) in classes.items():
        words[g], total[g] = n, c
    for w, c in top[:n_symbols]:
        words[class_of(w)] -= 1
        total[class_of(w)] -= c
    symbol_counts = np.concatenate([[ends], common_counts[:n_symbols], total])
    tokens = sum(c for _, c in classes.values()) + ends
    distinct = sum(n for n, _ in classes.values()) + (ends > 0)
    return Counts(tokens, distinct, ends, pa.array(common, pa.binary()), common_counts, n_symbols, symbol_counts, np.log10(total + words + 1), table)


def most_common(table: DataFrame) -> list[tuple[bytes, int]]:
    """The COMMON words of the largest counts, told to three digits; of the last such count those with the smallest hash. Commonest first."""
    step = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10("c")) - 2, F.lit(0)))
    table = table.withColumn("least", (F.floor(F.col("c") / step) * step).cast("long"))
    room, bounds = COMMON, None
    for row in sorted(table.groupBy("least").count().collect(), key=lambda r: -r.least):  # some thousand rows at most
        if row["count"] > room:
            bounds = row.least
            break
        room -= row["count"]
    rows = table.select("word", "c") if bounds is None else table.where(F.col("least") > bounds).select("word", "c")
    if bounds is not None and room:
        rows = rows.union(bounded_sample(table.where(F.col("least") == bounds).select("word", "c"), ["word"], room))
    return sorted(((bytes(r.word), int(r.c)) for r in rows.collect()), key=lambda x: (-x[1], x[0]))


def symbols_of(words: pa.Array, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its symbol, its place among the common words (-1: not there) and its class."""
    at = pc.fill_null(pc.index_in(words, value_set=counts.common), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    classes = classes_of(words)
    return np.where((at >= 0) & (at < counts.n_symbols), at + 1, 1 + counts.n_symbols + classes), at, classes


def with_ends(symbols: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's symbols in turn, the end (0) last, and where each text's begin (with the end of the last)."""
    lengths = np.bincount(doc, minlength=n) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.zeros(bounds[-1], dtype=np.uint16)
    flat[np.arange(len(symbols)) + doc] = symbols
    return flat, bounds


def symbol_lists(texts: list[str | None], counts: Counts) -> list[np.ndarray]:
    """Each text's symbols, the end last."""
    doc, codes, words = coded_words(pa.array(texts, pa.string()))
    flat, bounds = with_ends(symbols_of(words, counts)[0][codes], doc, len(texts))
    return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


@dataclass
class Ragged:
    """Rows by time: the symbols of all rows at time 0, then at time 1, ..., longest rows first in each."""

    order: np.ndarray  # the rows' indexes, longest first
    symbols: np.ndarray
    active: list[int]  # rows that reach each time
    offset: list[int]  # where each time begins
    row: np.ndarray  # of each symbol, as a place in ``order``

    @classmethod
    def of(cls, rows: list[np.ndarray], idx: list[int]) -> Ragged:
        lengths = np.array([len(rows[i]) for i in idx])
        active = (len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths[0]), side="right")).astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(active)])
        row = np.repeat(np.arange(len(idx)), lengths)
        time = np.concatenate([np.arange(n) for n in lengths])
        symbols, rows_at = np.empty(offset[-1], dtype=np.int64), np.empty(offset[-1], dtype=np.int64)
        symbols[offset[time] + row] = np.concatenate([rows[i] for i in idx])
        rows_at[offset[time] + row] = row
        return cls(np.array(idx), symbols, active.tolist(), offset.tolist(), rows_at)

    def stretches(self, most: int) -> list[tuple[int, int]]:
        """Times cut so that each stretch holds at most about ``most`` symbols."""
        out, a = [], 0
        while a < len(self.active):
            b = max(a + 1, int(np.searchsorted(self.offset, self.offset[a] + most, side="right")) - 1)
            out.append((a, min(b, len(self.active))))
            a = out[-1][1]
        return out


def ragged_groups(rows: list[np.ndarray], most: int):
    """Rows of like length together, at most about ``most`` symbols a group or one row."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    a = 0
    while a < len(order):
        b, held = a, 0
        while b < len(order) and (b == a or held + len(rows[order[b]]) <= most):
            held += len(rows[order[b]])
            b += 1
        yield Ragged.of(rows, order[a:b])
        a = b


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row a symbol, a column a state

    def _forward(self, g: Ragged, a: int, b: int, before: np.ndarray | None, alpha: np.ndarray | None, scale: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Scaled forward recursion over times a to b, from the vectors at a - 1; returns those at b - 1."""
        base = g.offset[a]
        now = before
        for t in range(a, b):
            n, o = g.active[t], g.offset[t] - base
            now = (self.start if t == 0 else now[:n] @ self.move) * emitted[o : o + n]
            s = np.add.reduce(now, axis=1)
            now /= s[:, None]
            scale[o : o + n] = s
            if alpha is not None:
                alpha[o : o + n] = now
        return now

    def log_likelihoods(self, rows: list[np.ndarray], most: int = HELD) -> np.ndarray:
        """log10 probability of each symbol row, by the scaled forward recursion over all rows of like length at once."""
        out = np.zeros(len(rows))
        for g in ragged_groups(rows, 4 * most):
            total, now = np.zeros(len(g.order)), None
            for a, b in g.stretches(most):
                x, y = g.offset[a], g.offset[b]
                scale = np.empty(y - x)
                now = self._forward(g, a, b, now, None, scale, self.emit[g.symbols[x:y]])
                total += np.bincount(g.row[x:y], weights=np.log10(scale), minlength=len(total))
            out[g.order] = total
        return out

    def expected(self, rows: list[np.ndarray], most: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of the rows (one forward and one backward pass)."""
        return self.expected_and_likelihood(rows, most)[:3]

    def expected_and_likelihood(self, rows: list[np.ndarray], most: int = HELD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """``expected``, and the sum of the rows' log10 probabilities, which the forward pass has anyway.

        Whole rows, however long: where a row's vectors are too many to hold, those
        between stretches are kept and a stretch's own are computed again as the
        backward pass comes to it.
        """
        start, move, emit, likelihood = np.zeros_like(self.start), np.zeros_like(self.move), np.zeros_like(self.emit), 0.0
        states, back = len(self.start), np.ascontiguousarray(self.move.T)
        for g in ragged_groups(rows, most):
            stretches = g.stretches(most)
            entering = [None]
            for a, b in stretches[:-1]:
                x, y = g.offset[a], g.offset[b]
                entering.append(self._forward(g, a, b, entering[-1], None, np.empty(y - x, self.emit.dtype), self.emit[g.symbols[x:y]]))
            coming = None  # emissions times backward vectors over scales, at the time after the stretch
            for (a, b), before in zip(reversed(stretches), reversed(entering)):
                x, y = g.offset[a], g.offset[b]
                emitted = self.emit[g.symbols[x:y]]
                alpha, scale = np.empty_like(emitted), np.empty(y - x, self.emit.dtype)
                last = self._forward(g, a, b, before, alpha, scale, emitted)
                emitted /= scale[:, None]
                beta = np.ones_like(emitted)
                if coming is not None:
                    move += self.move * (last[: len(coming)].T @ coming)
                for t in range(b - 1, a - 1, -1):
                    n, o = g.active[t], g.offset[t] - x
                    if coming is not None:
                        np.matmul(coming, back, out=beta[o : o + len(coming)])
                    coming = emitted[o : o + n] * beta[o : o + n]
                likelihood += float(np.log10(scale, dtype=np.float64).sum())
                emitted *= beta
                later = g.offset[a + 1] - x
                if later < y - x:  # each vector meets the one of its row a time before
                    width = np.repeat(g.active[a : b - 1], g.active[a + 1 : b])
                    move += self.move * (alpha[np.arange(later, y - x) - width].T @ emitted[later:])
                alpha *= beta
                if a == 0:
                    start += alpha[: g.active[0]].sum(axis=0)
                for k in range(states):
                    emit[:, k] += np.bincount(g.symbols[x:y], weights=alpha[:, k], minlength=len(emit))
        return start, move, emit, likelihood

    def single(self) -> Model:
        """The model in single precision, which the expected counts are computed in."""
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


def updated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """Parameters from expected counts; each state's emissions lean on the corpus frequencies."""
    s = start + 1.0
    m = move + 1.0
    e = emit + PRIOR * prior[:, None]
    return Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def prior_of(counts: Counts) -> np.ndarray:
    p = counts.symbol_counts + 1.0
    return p / p.sum()


def seeded(rows: list[np.ndarray], counts: Counts) -> Model:
    """A first model from few whole texts: emissions start as noisy corpus frequencies, with states that last."""
    prior, draw = prior_of(counts), np.random.default_rng(5)
    emit = prior[:, None] * np.exp(draw.normal(0, 0.5, (len(prior), STATES)))
    model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), emit / emit.sum(axis=0))
    for _ in range(SEED_ROUNDS if rows else 0):
        model = updated(*model.expected(rows), prior)
    return model


def train(texts: DataFrame, counts: Counts, ws: Workspace) -> Model:
    """Baum-Welch over every text of ``texts`` (one column), pass after pass until the likelihood settles.

    Symbols are written once, two bytes each, for all passes. The first model is
    that of the SEED_TEXTS texts whose symbols have the smallest hash. A task sums its
    texts and sends one row of numbers a state; STATES + 1 tasks add these up,
    and STATES + 1 rows come to the driver. The likelihood a pass tells is that of
    the model it began with; a pass more is made until that gains too little.
    """
    told = texts.sparkSession.sparkContext.broadcast(_bare(counts))

    def encode(batches):
        for batch in batches:
            doc, codes, words = coded_words(batch.column(0))
            flat, bounds = with_ends(symbols_of(words, told.value)[0][codes], doc, len(batch))
            offsets = pa.py_buffer((2 * bounds).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, offsets, pa.py_buffer(flat.tobytes())])], names=["symbols"])

    encoded = ws.save(texts.mapInArrow(frugal(encode), "symbols binary"), "symbols")
    rows = [np.frombuffer(r.symbols, np.uint16) for r in bounded_sample(encoded, ["symbols"], SEED_TEXTS).collect()]
    model = seeded(rows, counts)
    before = None
    while True:
        got = summed(encoded, model)
        if got is None:
            break
        *sums, likelihood = got
        model = updated(*sums, prior_of(counts))
        if before is not None and likelihood - before < SETTLED * abs(before):
            break
        before = likelihood
    ws.drop(encoded)
    return model


def summed(encoded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Expected starts, moves and emissions of all texts under the model, and their log10 likelihood; None without a text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model.single())

    def run(batches):
        m = shared.value
        start, move, emit, likelihood = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(m.emit.shape), 0.0
        for batch in batches:
            rows = [np.frombuffer(v, np.uint16) for v in batch.column(0).to_pylist()]
            got = m.expected_and_likelihood(rows)
            start += got[0]
            move += got[1]
            emit += got[2]
            likelihood += got[3]
        blobs = [emit[:, k].tobytes() for k in range(STATES)] + [np.concatenate([start, move.ravel(), [likelihood]]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(STATES + 1), pa.int32()), pa.array(blobs, pa.binary())], names=["k", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "v"])

    parts = encoded.mapInArrow(frugal(run), "k int, v binary")
    got = {r.k: np.frombuffer(r.v) for r in parts.repartition(STATES + 1, "k").mapInArrow(add, "k int, v binary").collect()}
    shared.unpersist()
    if STATES not in got:
        return None
    last = got[STATES]
    return last[:STATES], last[STATES:-1].reshape(STATES, STATES), np.stack([got[k] for k in range(STATES)], axis=1), float(last[-1])


def _bare(counts: Counts) -> Counts:
    return replace(counts, table=None)


def score(docs: DataFrame, counts: Counts, model: Model, ws: Workspace, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, with n_tokens, n_known, base_score and score (log10).

    Common words are looked up where the text lies; a text's other words leave as
    (row, word, times), meet the counts in a join, and come back as one sum a row.
    """
    spark = ws.spark
    told, shared = spark.sparkContext.broadcast(_bare(counts)), spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    added = "row_key long, n_tokens long, known long, base double, own double, chain double, words array<binary>, times array<int>"

    def run(batches):
        from pyspark import TaskContext

        c, m = told.value, shared.value
        row, log_all = TaskContext.get().partitionId() << 40, float(np.log10(c.tokens + c.distinct + 1))
        logs = np.append(np.log10(c.common_counts + 1.0), 0.0)  # the last is for words that aren't common
        end = float(np.log10(c.ends + 1))
        for batch in batches:
            n = len(batch)
            doc, codes, words = coded_words(batch.column(len(keep)))
            symbol, at, group = symbols_of(words, c)
            flat, bounds = with_ends(symbol[codes], doc, n)
            chain = m.log_likelihoods([flat[a:b] for a, b in zip(bounds, bounds[1:])])
            value = logs[at]
            within = np.where((at >= 0) & (at < c.n_symbols), 0.0, value - c.log_class[group])  # a word's share of its class
            size = np.diff(bounds)

            def total(of_word):
                return np.bincount(doc, weights=of_word[codes], minlength=n)

            rare = (at < 0)[codes]
            pair, times = np.unique(doc[rare] * max(1, len(words)) + codes[rare], return_counts=True)
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(words)), minlength=n))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(row + np.arange(n)), pa.array(size),
                 pa.array(total((at >= 0).astype(float)).astype(np.int64) + (c.ends > 0)), pa.array(total(value) + end - size * log_all), pa.array(total(within)), pa.array(chain),
                 pa.ListArray.from_arrays(lists, words.take(pa.array(pair % max(1, len(words))))), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                names=[*keep, "row_key", "n_tokens", "known", "base", "own", "chain", "words", "times"],
            )
            row += n

    scored = ws.save(docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(frugal(run), f"{fields}, {added}"), "scored")
    rare = scored.select("row_key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row_key", "w.words", "w.times")
    met = rare.join(counts.table, rare.words == counts.table.word)
    sums = met.groupBy("row_key").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(sums, "row_key", "left").select(
        *keep, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
        (F.col("chain") + F.col("own") + more).alias("score"),
    )
