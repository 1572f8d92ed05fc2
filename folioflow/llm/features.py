"""Hashed features of texts, computed with arrays, for the linear models."""

from __future__ import annotations

import numpy as np
import xxhash


def _letters(limit: int) -> np.ndarray:
    """For code points under ``limit``: the lower-case letter, or a blank for anything else."""
    out = np.full(limit, 32, dtype=np.uint32)
    for c in range(limit):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, runs of anything but letters as one blank; blanks around."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters(0x30000)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _TABLE[np.minimum(codes, 0x2FFFF)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    blank = codes == 32
    return codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def ngram_counts(codes: np.ndarray, orders: tuple[int, ...], bins: int) -> np.ndarray:
    """How often each hashed n-gram is in a text. ``bins`` is a power of two."""
    out = np.zeros(bins, dtype=np.int64)
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ codes[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out += np.bincount(h & np.uint32(bins - 1), minlength=bins)
    return out


def word_counts(words: list[bytes], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of hashed words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64(bins - 1)
    return np.unique(h.astype(np.int64), return_counts=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))
