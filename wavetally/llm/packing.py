"""Best-fit packing of documents into training sequences under several capacities at once.

Documents become pieces of at most ``tokens`` ids (only longer documents are
cut); pieces are packed into sequences whose residual is a vector: tokens,
number of pieces, and attention cost (the sum of squared lengths). A sequence
takes, again and again, the piece that fits all three and leaves the smallest
weighted residual norm (or has the largest weighted dot product with the
residual). Pieces of one length are interchangeable, so a choice looks at the
distinct lengths only, never at all pieces or all open sequences.

Packing is done in groups of about ``GROUP_PIECES`` pieces dealt out by hash; a
group's last sequences are all that splitting costs. Only (document, piece,
length) rows move, never texts or ids.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each for itself; equal lengths are taken in order of (doc_id, piece);
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import extended, slices
from wavetally.llm.tokens import word_encoder
from wavetally.session import materialize

GROUP_PIECES = 20_000
CACHED_WORDS = 600_000
ID_BYTES = 4


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. ``attention`` None: as much as one piece that fills it."""

    tokens: int = 2048
    pieces: int = 2048
    attention: int | None = None

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces, self.attention or self.tokens**2], dtype=np.float64)


def cut(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path, CACHED_WORDS)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = length * ID_BYTES
        for part in slices(batches):
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    held = ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // ID_BYTES)
                    size.append(len(held) // ID_BYTES)
                    crc.append(zlib.crc32(held))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, size, crc)],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fill(lengths: np.ndarray, capacity: Capacity, weights=(1.0, 1e-6, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, pieces of one length in the order given."""
    full = capacity.vector
    order = np.argsort(-lengths, kind="stable")
    sizes, first, left = np.unique(-lengths[order], return_index=True, return_counts=True)
    sizes = -sizes.astype(np.float64)
    need = np.stack([sizes, np.ones(len(sizes)), sizes**2], axis=1)
    if len(need) and (need.max(axis=0) > full).any():
        raise ValueError("a piece exceeds a sequence's capacity")
    scaled, w = need / full, np.asarray(weights, dtype=np.float64)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number, todo = 0, len(lengths)
    while todo:
        residual, at = full.copy(), 0
        while True:
            # sizes run from large to small: those that fit are a suffix, less what is used up
            open_from = np.searchsorted(-sizes, -residual[0])
            fits = left[open_from:] > 0
            if residual[1] < 1:
                break
            fits &= need[open_from:, 2] <= residual[2]
            if not fits.any():
                break
            r = residual / full
            if rule == "norm":
                cost = ((r - scaled[open_from:]) ** 2 * w).sum(axis=1)
            else:
                cost = -(scaled[open_from:] * (r * w)).sum(axis=1)
            k = open_from + int(np.where(fits, cost, np.inf).argmin())
            piece = order[first[k]]
            first[k] += 1
            left[k] -= 1
            sequence[piece], offset[piece] = number, at
            at += int(sizes[k])
            residual -= need[k]
            todo -= 1
        number += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    pieces = materialize(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    cap = (capacity.tokens, capacity.pieces, capacity.attention)

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = fill(np.asarray(table.column("length")), Capacity(*cap))
        ids = pa.array(sequence + (key[0].as_py() << 32), pa.int64())
        return table.drop_columns(["_group"]).append_column("sequence_id", ids).append_column("offset", pa.array(offset, pa.int64()))

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    schema = extended(pieces.schema, "sequence_id long, offset long")
    return pieces.withColumn("_group", group).groupBy("_group").applyInArrow(packed, schema)
