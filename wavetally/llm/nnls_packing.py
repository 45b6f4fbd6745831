"""Packing by non-negative least squares over shallow combinations of lengths.

Every document longer than a sequence gives full sequences and one tail. What is
left is a histogram of lengths with as many entries as a sequence has tokens.
All combinations of up to ``DEPTH`` lengths that exactly fill a window (the
sequence, or a smaller power of two, several of which fill a sequence) are the
columns of a least-squares problem whose right side is the histogram: how often
should each combination be used, never less than 0 times, so that all documents
are used up? The solution is rounded within the counts that there are. Documents
that no rounded combination takes are laid end to end and cut where a sequence
is full; what the last one holds is cut into powers of two, so no sequence is padded.

Histogram and solution are of fixed size and are worked out on the driver; the
work on documents is spread. A document's place follows from its length and its
number among those of its length by arithmetic on the solution, so no document
meets another one: each task numbers its own by length, counts per (task, length)
give where it starts, and only (document, length) rows move. Ids move only for
documents that are cut anew.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each for itself; ties go by the order of rows in the input's splits; an
empty table gives no rows; other columns of the input are ignored. A text is
encoded whole, whatever its length, and only its tail is stored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.llm.common import mix64, slices
from wavetally.llm.tokens import WordEncoder
from wavetally.operators.ordered import broadcast_if_small
from wavetally.session import materialize

DEPTH = 3
# Passes over all combinations, and rounds of descent after each; the fit ends when a pass takes less than this share off
# the squared error, or the error is this share of the histogram's square. A combination is looked at closer if it gains this share of the best at one of its lengths.
PASSES = 100
INNER = 40
LEAST_GAIN = 1e-2
ENOUGH = 1e-8
NEAR = 0.9

ID_BYTES = 4

# Words whose ids a task keeps (some 200 bytes each): more than a split of text commonly holds.
CACHED_WORDS = 600_000


def combinations(window: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """All multisets of up to three lengths that fill a power of two up to ``window``: the lengths, ascending behind zeros,
    and what they fill."""
    if window < 1 or window & (window - 1):
        raise ValueError("a sequence's length must be a power of two")
    if depth not in (1, 2, 3):
        raise ValueError("one to three lengths per combination")
    found, filled, w = [], [], window
    while w:
        parts = [np.array([[0, 0, w]])]
        if depth > 1:
            i = np.arange(1, w // 2 + 1)
            parts.append(np.stack([np.zeros_like(i), i, w - i], axis=1))
        for i in range(1, w // 3 + 1) if depth > 2 else ():
            j = np.arange(i, (w - i) // 2 + 1)
            parts.append(np.stack([np.full_like(j, i), j, w - i - j], axis=1))
        found += parts
        filled += [np.full(len(p), w) for p in parts]
        w //= 2
    return np.concatenate(found), np.concatenate(filled)


def _descend(columns: np.ndarray, norm: np.ndarray, tip: np.ndarray, x: np.ndarray, left: np.ndarray, rounds: int) -> None:
    """Move the repeats ``x`` of some combinations, and what is ``left`` of the histogram with them.

    Descent by blocks: in each round those combinations are moved that gain most at all their lengths. They share none, so
    each goes to its own best value, all at once; one that is used too often goes back in the same way."""
    flat = columns.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] > 0]
    lengths, first = np.unique(flat[order], return_index=True)
    owner = order // 3
    best = np.zeros(len(left))
    for _ in range(rounds):
        step = np.maximum(left[columns].sum(axis=1) / norm, -x)
        gain = step * (2 * left[columns].sum(axis=1) - step * norm) * tip
        best[lengths] = np.maximum.reduceat(gain[owner], first)
        move = np.flatnonzero((gain >= best[columns].max(axis=1)) & (gain > 0))
        if not len(move):
            break
        x[move] += step[move]
        np.subtract.at(left, columns[move], step[move, None])
        left[0] = 0


def nnls(columns: np.ndarray, counts: np.ndarray, passes: int = PASSES, least_gain: float = LEAST_GAIN) -> np.ndarray:
    """Repeats x >= 0 of every combination that bring the sum of ``counts - A x`` squared down to its least.

    Column ``c`` of A counts how often each length occurs in combination ``c``. Every pass looks at all combinations and
    takes those in use and those that would gain about as much as the best at some of their lengths; ``_descend`` then
    works on these alone."""
    left = counts.astype(np.float64)
    left[0] = 0
    x = np.zeros(len(columns))
    if not len(columns):
        return x
    a, b, c = columns.T
    pairs = ((a == b) & (a > 0)).astype(int) + ((b == c) & (b > 0))
    norm = np.where(pairs == 2, 9.0, np.where(pairs == 1, 2.0, 0.0) + (columns > 0).sum(axis=1))
    # equal gains are told apart, or their combinations would block each other
    tip = 1 + mix64(np.arange(1, len(columns) + 1, dtype=np.uint64)).astype(np.float64) / 2**64 * 1e-6
    error, best = float(left @ left), np.zeros(len(counts))
    enough = ENOUGH * error
    for _ in range(passes):
        slope = left[a] + left[b] + left[c]
        gain = np.where(slope > 0, slope * slope / norm, 0.0)
        best[:] = 0
        for part in (a, b, c):
            np.maximum.at(best, part, gain)
        best[0] = np.inf
        near = np.flatnonzero((x > 0) | ((gain > 0) & (gain >= NEAR * np.minimum(np.minimum(best[a], best[b]), best[c]))))
        some, moved = columns[near], x[near]
        _descend(some, norm[near], tip[near], moved, left, INNER)
        x[near] = moved
        now = float(left @ left)
        done, error = now <= enough or error - now <= least_gain * error, now
        if done:
            break
    return x


def rounded(columns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeats near x, the largest first, that use no length more often than it occurs."""
    left = counts.astype(np.int64).copy()
    repeats = np.zeros(len(columns), dtype=np.int64)
    used = np.flatnonzero(x > 0)
    used = used[np.argsort(-x[used], kind="stable")]
    for up in (False, True):
        for c in used.tolist():
            need: dict[int, int] = defaultdict(int)
            for length in columns[c].tolist():
                if length:
                    need[length] += 1
            aim = int(np.ceil(x[c]) if up else np.rint(x[c])) - int(repeats[c])
            times = min(aim, *(int(left[k]) // m for k, m in need.items()))
            if times > 0:
                repeats[c] += times
                for k, m in need.items():
                    left[k] -= times * m
    return repeats


@dataclass(frozen=True)
class Plan:
    """Where the n-th document of a length goes; arrays of a size bounded by the window.

    Slot ``i`` takes numbers ``number[i]`` up to the next slot's of the length ``length[i]``: the k-th of them is part of
    window ``window[i] + k`` among those of ``filled[i]`` tokens, at ``inside[i]``. From ``taken[length]`` on documents lie
    end to end, from place ``behind[length]`` of a row of ``rest`` tokens on."""

    size: int
    length: np.ndarray
    number: np.ndarray
    window: np.ndarray
    filled: np.ndarray
    inside: np.ndarray
    taken: np.ndarray
    behind: np.ndarray
    first_sequence: dict[int, int]
    sequences: int
    rest: int


def solve(counts: np.ndarray, size: int, depth: int = DEPTH) -> Plan:
    """The plan for ``counts[length]`` documents of each length up to ``size``."""
    columns, filled = combinations(size, depth)
    there = (counts[columns] > 0) | (columns == 0)
    columns, filled = columns[there.all(axis=1)], filled[there.all(axis=1)]
    repeats = rounded(columns, nnls(columns, counts), counts)
    # windows of one kind fill whole sequences; the few beyond are given up
    for w in np.unique(filled).tolist():
        mine = np.flatnonzero((filled == w) & (repeats > 0))
        beyond = int(repeats[mine].sum()) % (size // w)
        for c in mine[::-1].tolist():
            less = min(beyond, int(repeats[c]))
            repeats[c] -= less
            beyond -= less
    columns, filled, repeats = columns[repeats > 0], filled[repeats > 0], repeats[repeats > 0]
    slots, taken = [], np.zeros(size + 1, dtype=np.int64)
    first_sequence, sequences, windows = {}, 0, defaultdict(int)
    for w in np.unique(filled).tolist():
        first_sequence[w] = sequences
        sequences += int(repeats[filled == w].sum()) * w // size
    for parts, w, times in zip(columns.tolist(), filled.tolist(), repeats.tolist()):
        inside = 0
        for length in filter(None, parts):
            slots.append((length, int(taken[length]), windows[w], w, inside))
            taken[length] += times
            inside += length
        windows[w] += times
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5).T
    rest = (counts - taken) * np.arange(size + 1)
    return Plan(size, *table, taken, np.cumsum(rest) - rest, first_sequence, sequences, int(rest.sum()))


def cuts(plan: Plan, start: int, end: int) -> list[tuple[int, int, int, int]]:
    """From, to, sequence and offset of the stretches of the row of left documents between two places.

    Cut after every full sequence; behind the last full one after powers of two, the largest first."""
    out, full = [], plan.rest // plan.size * plan.size
    while start < end:
        if start < full:
            number, begin, stop = plan.sequences + start // plan.size, start // plan.size * plan.size, (start // plan.size + 1) * plan.size
        else:
            number, begin, left = plan.sequences + full // plan.size, full, plan.rest - full
            stop = begin + (1 << left.bit_length() - 1)
            while stop <= start:
                left -= stop - begin
                number, begin, stop = number + 1, stop, stop + (1 << left.bit_length() - 1)
        to = min(end, stop)
        out.append((start, to, number, start - begin))
        start = to
    return out


def encoded(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, cached: int = CACHED_WORDS) -> DataFrame:
    """Full pieces and tails: row, doc_id, start, length, ids_crc32, doc_tokens; of tails also the number among those of
    this length in this task, and the ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, cached)
        end = np.array([end_id], dtype="<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for part in slices(batches):
            row, start, length, crc, total, number, held = [], [], [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // ID_BYTES
                for at in range(0, n, size):
                    piece = ids[at * ID_BYTES : (at + size) * ID_BYTES]
                    m = len(piece) // ID_BYTES
                    row.append(i)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    number.append(seen[m])
                    held.append(piece if m < size else None)
                    seen[m] += 1
            longs = [pa.array(v, pa.int64()) for v in (start, length, crc, total, number)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row, pa.int64())), *longs, pa.array(held, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, number long, ids binary"
    out = docs.select("doc_id", "text").mapInArrow(pieces, ddl).withColumn("row", F.monotonically_increasing_id())
    return out.withColumn("task", F.shiftright("row", 33))


def placed(numbered: DataFrame, plan: Plan) -> DataFrame:
    """Rows with ``sequence_id``, ``offset`` and, for those that are cut, ``skip``: ids of the piece before the cut."""
    kind = numbered.schema["doc_id"].dataType.simpleString()
    bits = 42
    keys = (plan.length << bits) + plan.number
    first = np.zeros(plan.size + 1, dtype=np.int64)
    for w, sequence in plan.first_sequence.items():
        first[w] = sequence

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
            start, crc = np.asarray(batch.column("start")), np.asarray(batch.column("ids_crc32"))
            fits = number < plan.taken[length]
            if len(keys):
                slot = np.searchsorted(keys, (length << bits) + number, side="right") - 1
                at = plan.window[slot] + number - plan.number[slot]
                per = plan.size // plan.filled[slot]
                sequence = first[plan.filled[slot]] + at // per
                offset = at % per * plan.filled[slot] + plan.inside[slot]
            else:
                sequence = offset = np.zeros_like(number)
            keep = np.flatnonzero(fits)
            rows = [keep]
            cols = [[start[keep]], [length[keep]], [crc[keep]], [sequence[keep]], [offset[keep]], [np.full(len(keep), -1)]]
            for i in np.flatnonzero(~fits).tolist():
                place = int(plan.behind[length[i]] + (number[i] - plan.taken[length[i]]) * length[i])
                pieces = cuts(plan, place, place + int(length[i]))
                rows.append(np.full(len(pieces), i))
                for a, b, s, o in pieces:
                    whole = len(pieces) == 1
                    for col, v in zip(cols, (start[i] + a - place, b - a, crc[i], s, o, -1 if whole else a - place)):
                        col.append(np.array([v]))
            take = pa.array(np.concatenate(rows))
            data = [pa.array(np.concatenate(c).astype(np.int64)) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("row", "doc_id", "doc_tokens")), *data],
                ["row", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "skip"],
            )

    ddl = f"row long, doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, skip long"
    return numbered.select("row", "doc_id", "doc_tokens", "start", "length", "ids_crc32", "number").mapInArrow(place, ddl)


def _crc_of_part(rows: DataFrame) -> DataFrame:
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skip, length = batch.column("skip").to_pylist(), batch.column("length").to_pylist()
            ids = batch.column("ids").to_pylist()
            found = [zlib.crc32(memoryview(v)[a * ID_BYTES : (a + n) * ID_BYTES]) for v, a, n in zip(ids, skip, length)]
            names = [n for n in batch.schema.names if n not in ("ids", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], [*names, "ids_crc32"])

    fields = [f for f in rows.schema.fields if f.name not in ("ids", "ids_crc32")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(crc, f"{ddl}, ids_crc32 long")


def pack_by_histogram(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, depth: int = DEPTH) -> DataFrame:
    """All documents in sequences of ``size`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialize(encoded(docs, tokenizer_path, size, end_id), "encoded-tails")
    here = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "length-counts")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    plan = solve(counts, size, depth)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = here.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    numbered = pieces.drop("ids").join(shift, ["task", "length"]).withColumn("number", F.col("number") + F.col("shift"))
    out = materialize(placed(numbered, plan), "placed-pieces")
    ids = pieces.where("ids IS NOT NULL").select("row", "ids")
    # few documents are cut anew; counted, they go to where the ids lie
    parts = _crc_of_part(ids.join(broadcast_if_small(out.where("skip >= 0")), "row"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.where("skip < 0").select(*columns).unionByName(parts.select(*columns))
