"""Bloom filters over 64-bit hashes, built in parts by tasks and put together segment by segment."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavetally.llm.common import mix64

HASHES = 4
SEGMENT_BITS = 1 << 18
MAX_BITS = 1 << 28  # 32 MB, the most that is broadcast


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, keys) bit positions; ``bits`` is a power of two."""
    step = mix64(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)])


def contains(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = positions(hashes, 8 * len(filter_bytes))
    return ((filter_bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def bitmaps(hashes: np.ndarray, bits: int) -> dict[int, np.ndarray]:
    """Bit arrays of the segments that the hashes touch."""
    at = np.unique(positions(hashes, bits)).astype(np.int64)
    segment = at // SEGMENT_BITS
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(at) else []
    out = {}
    for a, b in zip(starts, [*starts[1:], len(at)]):
        flags = np.zeros(min(bits, SEGMENT_BITS), dtype=np.uint8)
        flags[at[a:b] % SEGMENT_BITS] = 1
        out[int(segment[a])] = np.packbits(flags, bitorder="little")
    return out


def assembled(segments: DataFrame, column: str, bits: int) -> np.ndarray:
    """The whole filter, of ``bits`` / 8 bytes, from one compressed row per segment."""
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in segments.select("segment", column).toLocalIterator():
        raw = np.frombuffer(zlib.decompress(row[column]), np.uint8)
        at = row["segment"] * SEGMENT_BITS // 8
        out[at : at + len(raw)] = raw
    return out


def of_column(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter of a column of longs that are hashes already."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, b in bitmaps(np.asarray(batch.column(0)).view(np.uint64), bits).items():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], ["segment", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([zlib.compress(held.tobytes(), 1)], pa.binary())], ["segment", "part"])
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(zlib.decompress(b), np.uint8)
                if s != current and current is not None:
                    yield done()
                held = new if s != current else held | new
                current = s
        if current is not None:
            yield done()

    schema = "segment long, part binary"
    made = df.where(f"`{column}` IS NOT NULL").select(column).mapInArrow(parts, schema)
    return assembled(made.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, schema), "part", bits)
