"""Words and word n-grams of many texts at once, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. Words are hashed without a
Python object for any of them: prefix sums of a polynomial over the bytes give
every word's hash by one subtraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wavetally.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM = np.uint64(0xD6E8FEB86659FD93)
_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# For words of letters and digits alone: everything else in ASCII sets words apart.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a column of texts.

    ``start``/``end``: bytes of each word within ``data``; words of text ``i`` are
    ``first[i]:first[i + 1]``.
    """

    def __init__(self, column: pa.Array, blanks: np.ndarray = _SPACE):
        self.data, self.text_at = utf8(column)
        blank = blanks[self.data]
        begins = ~blank
        if len(begins):
            begins[1:] &= blank[:-1]
            fresh = self.text_at[:-1]
            fresh = fresh[fresh < len(blank)]
            begins[fresh] = ~blank[fresh]
        self.start = np.flatnonzero(begins)
        stops = np.append(np.flatnonzero(blank), len(blank))
        self.end = stops[np.searchsorted(stops, self.start)]
        self.first = np.searchsorted(self.start, self.text_at)
        texts = np.searchsorted(self.text_at, self.start, side="right") - 1
        self.end = np.minimum(self.end, self.text_at[texts + 1]) if len(self.start) else self.end
        self.blank = blank

    def __len__(self) -> int:
        return len(self.text_at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of every word; with ``lower``, A-Z count as a-z."""
        data = _LOWER[self.data] if lower else self.data
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_KEYS[data] * powers(_BASE, len(data)), out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * powers(_INVERSE, len(data) + 1)[self.start])

    def totals(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.text_at])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, running over text ends as well."""
    m = max(0, len(hashes) - n + 1)
    out = hashes[:m].copy()
    for i in range(1, n):
        out = out * _NGRAM + hashes[i : i + m]
    return mix64(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a short sequence of words; sequences of different length differ."""
    h = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for x in hashes:
            h = h * _NGRAM + x
        return mix64(np.array([h ^ _BASE], dtype=np.uint64))


def shingle_sets(words: Words, n: int, lower: bool = True) -> list[np.ndarray]:
    """Per text its distinct ``n``-word shingles in ascending hash order.

    With fewer words the whole sequence is the only shingle; without words the set is empty."""
    hashes = words.hashes(lower)
    grams = ngrams(hashes, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(whole(hashes[a:b]) if b > a else hashes[:0])
    return out
