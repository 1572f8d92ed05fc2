"""Byte-level BPE encoding and decoding with the tokenizers library.

``encode`` turns whole texts into token ids over Arrow batches, with the byte
and character offset of every token on request; ``decode`` reverses the byte
table, so that characters split between tokens come back whole.

Cases: a null text counts as empty and has no token; repeated rows are encoded
each by themselves; other columns, whatever their names, pass through, and an
operator's own column that clashes with one of theirs replaces it.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import frugal, small_batches

#: Texts handled at a time within an Arrow batch, in bytes (a longer text is a batch of its own).
CHUNK_CHARS = 4_000_000
#: Units whose ids one worker remembers, at some 40 bytes each. Only speed depends on it.
MEMO_UNITS = 500_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    table = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        table[int(rank)] = base64.b64decode(token)
    return table


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that splits by ``pattern`` and merges by rank.

    A rank file names tokens, not merges: any two neighbours whose bytes
    together are a token may merge, the lowest rank first. So every split of a
    token into two tokens becomes a merge, in order of the token's rank, and a
    piece that is itself a token is taken whole.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table, alphabet = read_ranks(path), byte_alphabet()
    spell = {token: "".join(map(alphabet.__getitem__, token)) for token in table if token}
    merges = [
        (spell[token[:k]], spell[token[k:]])
        for token in table
        for k in range(1, len(token))
        if token[:k] in spell and token[k:] in spell
    ]
    vocab = {spell[token]: i for i, token in enumerate(table) if token}
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return out, table


def tokenizer_from_json(path: str):
    """A byte-level tokenizers.Tokenizer from its file, and its token bytes by id.

    Strings of special tokens within a text are what the library makes of them.
    """
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = out.get_vocab()
    table = [b""] * (1 + max(vocab.values()))
    for token, i in vocab.items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out, table


class Encoder:
    """Encodes texts, remembering what common units (a blank and the word after it) become.

    The split patterns of byte-level BPE always begin a piece at a blank that
    stands before a visible character, so such units never share a piece, and
    the ids of a text are those of its units in turn. Texts in which a blank
    stands before another white space, or at the end, go to the library whole.

    What is remembered is one Arrow array of units and, as arrays, where the ids
    of each lie; a batch's units are looked up all at once.
    """

    def __init__(self, tokenizer, table: list[bytes], memo_units: int = MEMO_UNITS):
        self.tokenizer, self.table, self.memo_units = tokenizer, table, memo_units
        self.opens = np.array([t[:1] == b" " for t in table])
        self.spelled = spelling(table)
        self.known = pa.array([], pa.string())
        self.ids, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in turn, and where each text's begin (with the end of the last)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, found)])
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(ends[-1])), ends

    def _learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_whole``, for units that each follow a blank: many in one call, cut where an id opens with a blank."""
        step, ids, sizes = 4000, [], []
        for i in range(0, len(units), step):
            group = units.slice(i, step).to_pylist()
            mine, cuts = self._whole([" " + " ".join(group)])
            cuts = np.append(np.flatnonzero(self.opens[mine]), len(mine))
            if len(cuts) != len(group) + 1 or cuts[0]:
                mine, cuts = self._whole([" " + u for u in group])
            ids.append(mine), sizes.append(np.diff(cuts))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and where each text's ids begin (with the end of the last)."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = parts.flatten().dictionary_encode()
        codes, units = coded.indices.to_numpy(), coded.dictionary
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        heads = bounds[:-1]  # each text has a first unit, if only an empty one
        later = np.ones(len(codes), dtype=bool)
        later[heads] = False
        odd = pc.or_(pc.equal(pc.binary_length(units), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(units, 0, 1))).to_numpy(zero_copy_only=False)
        whole = np.zeros(n, dtype=bool)
        whole[doc[odd[codes] & later]] = True
        later &= ~whole[doc]

        wanted = np.zeros(len(units), dtype=bool)
        wanted[codes[later]] = True
        at = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy().copy()
        fresh = wanted & (at < 0)
        new = units.filter(pa.array(fresh))
        ids, ends = self.ids, self.ends
        if len(new):
            more, more_ends = self._learn(new)
            at[fresh] = len(ends) - 1 + np.arange(len(new))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + more_ends[1:]])
            room = max(0, self.memo_units - len(self.known))
            if room:
                self.known = pa.concat_arrays([self.known, new.slice(0, room)])
                self.ends = ends[: len(self.known) + 1].copy()
                self.ids = ids[: self.ends[-1]].copy()
        said = units.take(pa.array(codes[heads])).to_pylist()
        for i in np.flatnonzero(whole).tolist():
            said[i] = texts[i].as_py()
        own, own_ends = self._whole(said)

        sizes = np.append(np.diff(ends), 0)  # the last is for units that say nothing
        place = np.where(later, at[codes], len(sizes) - 1).astype(np.int32)
        begin, count = ends.astype(np.int32)[place], sizes.astype(np.int32)[place]
        begin[heads], count[heads] = len(ids) + own_ends[:-1], np.diff(own_ends)
        upto = np.cumsum(count, dtype=np.int64)
        if not n:
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        index = np.arange(upto[-1], dtype=np.int32)
        index += np.repeat(begin - (upto - count).astype(np.int32), count)
        return np.concatenate([ids, own])[index], np.concatenate([[0], upto[bounds[1:] - 1]])

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return decoded_of(self.spelled, flat, bounds)


def spelling(table: list[bytes]) -> pa.Array:
    return pa.array([t or None for t in table], pa.binary())


def decoded_of(spelled: pa.Array, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each text's ids, joined; an id that the vocabulary lacks is an error."""
    told = spelled.take(pa.array(flat))
    if told.null_count:
        raise ValueError("an id is not in the vocabulary")
    _, offsets, data = told.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[bounds] if len(told) else np.zeros(len(bounds), dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str | None = None, memo_units: int = MEMO_UNITS) -> Encoder:
    """This worker's encoder for a vocabulary: a rank file with its split pattern, or a tokenizer file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*(tokenizer_from_ranks(path, pattern) if pattern else tokenizer_from_json(path)), memo_units)
    return _ENCODERS[key]


_TABLES: dict[tuple, list[bytes]] = {}


def token_table(path: str, pattern: str | None = None) -> list[bytes]:
    """This worker's token bytes by id, without a tokenizer."""
    if (path, pattern) not in _TABLES:
        _TABLES[path, pattern] = read_ranks(path) if pattern else tokenizer_from_json(path)[1]
    return _TABLES[path, pattern]


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of at most about CHUNK_CHARS characters, or of one text."""
    begin = chars = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy()):
        if chars and chars + n > CHUNK_CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += int(n) + 64
    if begin < len(texts):
        yield begin, len(texts)


def int_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


def token_offsets(flat: np.ndarray, bounds: np.ndarray, texts: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each token in its text: in bytes, and as the index of the character that the byte belongs to."""
    ends = np.cumsum(lengths[flat])
    starts = ends - lengths[flat]
    data = np.frombuffer("".join(texts.fill_null("").to_pylist()).encode(), dtype=np.uint8)
    char_at = np.cumsum((data & 0xC0) != 0x80) - 1
    chars = char_at[starts]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    text_start = np.concatenate([[0], ends])[bounds[:-1]]
    char_start = np.append(char_at, len(char_at) and char_at[-1] + 1)[np.minimum(text_start, len(data))] if len(data) else text_start
    return starts - text_start[doc], chars - char_start[doc]


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in added}
    return pa.RecordBatch.from_pydict(kept | added)


def schema_with(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + added)


def encode(
    docs: DataFrame, path: str, pattern: str | None = None, text_col: str = "text", offsets: bool = False, decoded: bool = False,
    exact: bool = False, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``ids`` (array of int) and, on request, ``byte_starts`` and ``char_starts`` (``offsets``),
    what the ids ``decode`` to (``decoded``), and whether those are the text's very bytes (``exact``).

    ``path`` is a tokenizer file, or with ``pattern`` a file of token ranks; the
    executors must have it at that place. Of the columns those in ``keep`` pass
    (all, if None). No row moves: one Arrow pass, whose memory is bounded by a
    slice of the batch and the longest text.
    """
    ints = T.ArrayType(T.IntegerType())
    new = [T.StructField(n, ints) for n in ("ids", *(("byte_starts", "char_starts") if offsets else ()))]
    new += [T.StructField("decoded", T.BinaryType())] if decoded else []
    new += [T.StructField("exact", T.BooleanType())] if exact else []
    passed = list(docs.columns if keep is None else keep)
    small_batches(docs.sparkSession)
    schema = schema_with(docs.select(*[f"`{c}`" for c in passed]), new)

    def run(batches):
        enc = encoder(path, pattern)
        lengths = np.array([len(t) for t in enc.table])
        for batch in batches:
            column, rest = batch.column(len(passed)), batch.select(list(range(len(passed))))
            for a, b in text_slices(column):
                texts = column.slice(a, b - a)
                flat, bounds = enc.encode(texts)
                added = {"ids": int_lists(flat, bounds)}
                if offsets:
                    in_bytes, in_chars = token_offsets(flat, bounds, texts, lengths)
                    added |= {"byte_starts": int_lists(in_bytes, bounds), "char_starts": int_lists(in_chars, bounds)}
                if decoded or exact:
                    said = enc.decode(flat, bounds)
                    added |= {"decoded": said} if decoded else {}
                    added |= {"exact": pc.equal(said, pc.fill_null(texts, "").cast(pa.binary()))} if exact else {}
                yield with_columns(rest.slice(a, b - a), added)

    return docs.select(*[f"`{c}`" for c in passed], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(frugal(run), schema)


def decode(df: DataFrame, path: str, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, joined before anything reads them as characters.

    A token may end within a character; only the joined bytes are UTF-8. Null
    ids decode to no bytes. An id that the vocabulary lacks is an error.
    """
    schema = schema_with(df, [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        spelled = spelling(token_table(path, pattern))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            step = max(1, 500_000 // max(1, len(lists.flatten()) // max(1, len(lists))))
            for a in range(0, len(lists), step):
                part = lists.slice(a, step)
                bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy().astype(np.int64))])
                yield with_columns(batch.slice(a, step), {"decoded": decoded_of(spelled, part.flatten().to_numpy(zero_copy_only=False), bounds)})

    return df.mapInArrow(frugal(run), schema)
