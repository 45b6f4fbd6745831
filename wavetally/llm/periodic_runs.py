"""Periodic runs of words: stretches that repeat with a short period.

A run is a stretch of consecutive words with smallest period ``q`` and a length
of at least ``max(least, repeats * q)`` that neither neighbouring word extends.

The method is a sparse diagonal table. Word ``i`` that also stands at ``i - p``
adds one to the match length of diagonal (lag) ``p``; a lag that is not fed at
``i`` ends there, and if its length suffices a run has been found. Feeding every
earlier occurrence of a word would cost the square of its count, so a lag is
only fed where it can still become a run: with ``repeats`` >= 3, a run of lag
``p`` in (m/2, m] has matches of more than ``m`` words in a row, so an
earlier occurrence counts for these lags only if the ``m`` words that end there
are the same as those that end at ``i``. Of these the nearest is enough: inside
a run of smallest period ``p`` a stretch of ``m >= p`` words recurs at no shorter
distance (two periods ``d < p`` on ``m + d`` words would have a common smaller
one, by Fine and Wilf's theorem). So each word feeds at most one lag per power of
two, and a lag fed this way is always the smallest period. All words of a block of texts advance
together, in arrays; words without an equal stretch of ``m`` words leave before
``2m`` is looked at, so ordinary text is done after a few steps.

Nothing is shuffled. A text is handled whole; one larger than a block costs some
100 bytes per byte of it.

Defined results: null and empty texts have no runs and an empty collapsed text;
repeated rows are handled each for itself; an empty table gives no rows; other
columns pass through, and input columns named like a result are replaced. Words
are compared by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavetally.llm.common import extended, mix64, slices
from wavetally.llm.words import Words

LEAST = 6
REPEATS = 4

RESULT_DDL = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _before(classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the nearest earlier place of the same class (0: none), and whether the class occurs twice."""
    order = np.argsort(classes, kind="stable")
    same = classes[order][1:] == classes[order][:-1]
    lag = np.zeros(len(at), dtype=np.int64)
    lag[order[1:][same]] = np.diff(at[order])[same]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return lag, twice


def _diagonals(at: np.ndarray, lag: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every stretch over which a lag was fed without a break."""
    fresh = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(lag, prepend=-1) != 0))
    fed = np.diff(np.append(fresh, len(at)))
    period = lag[fresh]
    return at[fresh] - context + 1 - period, fed + context - 1 + period, period


def find_runs(hashes: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS):
    """Runs of several texts at once, by text, start and period: text, start, length, period.

    ``hashes``: of all words; those of text ``i`` are ``first[i]:first[i + 1]``. Starts count from the text's first word."""
    if repeats < 3:
        raise ValueError("a run repeats three times at least")
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes))
    classes = np.unique(mix64(hashes ^ mix64(text.astype(np.uint64) + np.uint64(1))), return_inverse=True)[1] if len(at) else at
    found, m = [], 1
    while len(at):
        lag, twice = _before(classes, at)
        fed = (lag > m // 2) & (lag <= m)
        start, length, period = _diagonals(at[fed], lag[fed], m)
        enough = length >= np.maximum(least, repeats * period)
        found.append(np.stack([start[enough], length[enough], period[enough]]))
        # stretches of 2m words: both halves occur twice, in one text that is long enough for such a lag
        at, classes = at[twice], classes[twice]
        half = np.searchsorted(at, at - m)
        known = (half < len(at)) & (at[np.minimum(half, len(at) - 1)] == at - m) if len(at) else np.zeros(0, bool)
        known &= (text[at] == text[np.maximum(at - m, 0)]) & (repeats * (m + 1) <= counts[text[at]])
        pair = classes[known] * (int(classes.max()) + 1 if len(classes) else 1) + classes[half[known]]
        at = at[known]
        classes = np.unique(pair, return_inverse=True)[1] if len(pair) else pair
        m *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    owner = np.searchsorted(first, start, side="right") - 1
    return owner, start - first[owner], length, period


def kept_words(first: np.ndarray, owner, start, length, period) -> np.ndarray:
    """False for the words that a run holds after its first period."""
    change = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(change, first[owner] + start + period, 1)
    np.add.at(change, first[owner] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text with one blank between."""
    mark = np.zeros(len(words.data) + 1, dtype=np.int8)
    at = np.flatnonzero(kept)
    mark[words.start[at]] += 1
    mark[words.end[at]] -= 1
    held = np.cumsum(mark[:-1], dtype=np.int8) > 0
    text = np.searchsorted(words.first, at, side="right") - 1
    blank = words.end[at[:-1][text[1:] == text[:-1]]]
    data = words.data.copy()
    data[blank], held[blank] = 32, True
    ends = np.zeros(len(held) + 1, dtype=np.int64)
    np.cumsum(held, out=ends[1:])
    offsets = ends[words.text_at].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data[held])])


def collapse_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period, by start and period) and ``collapsed``: the text's words without
    those that repeat, joined by one blank."""
    named = {"runs", "collapsed"}
    others = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in named])

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            owner, start, length, period = find_runs(words.hashes(lower=False), words.first, least, repeats)
            offsets = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
            texts = joined(words, kept_words(words.first, owner, start, length, period))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), fields), texts], [*part.schema.names, "runs", "collapsed"]
            )

    return others.mapInArrow(collapsed, extended(T.StructType(others.schema.fields), RESULT_DDL))
