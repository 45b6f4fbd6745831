"""Line dedup with two Bloom filters, one of keys seen once and one of keys seen twice.

A key is a line with white space stripped at both ends and A-Z lower-cased. The
first pass over the texts sets a key's bits in the filter "once", or, where the
filter has them already, in "twice". Parts of the filters are built where the
texts are read and merged segment by segment: what two parts have in "once"
belongs into "twice" as well, so that no repeated key is missed. The second pass
tests keys against "twice" and shuffles the suspects alone, where they are
counted exactly by their text. Texts move only to meet the keys they lose.

The filter has ``BITS_PER_LINE`` bits per line up to ``MAX_BITS``, which bounds
what is broadcast. Beyond that more keys are suspected than repeat: the result
is the same, the shuffle larger.

Defined results: a row is a document, so repeated rows count each; a null text
has one empty line and stays null; rows without doc_id rank below all others
and keep a line only where no other row has it; of equal largest doc_ids all
keep the line; an empty table gives no rows; all other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.bloom import MAX_BITS, assembled, bitmaps, contains
from wavetally.llm.common import extended, power_of_two, slices
from wavetally.session import materialize

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 16
BUFFERED_KEYS = 500_000
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # of bytes, lower() changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode()) >= min_chars)


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    """Distinct keys of at least ``min_chars`` code points."""
    return {k for k in map(line_key, (text or "").encode().split(b"\n")) if long_enough(k, min_chars)}


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """Bits of the filter of keys that two or more documents may have; at most ``bits`` / 8 bytes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush():
            hashes, n = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
            once, twice = bitmaps(hashes, bits), bitmaps(hashes[n > 1], bits)
            for s, b in once.items():
                again = zlib.compress(twice[s].tobytes(), 1) if s in twice else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s]), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary()), pa.array([again], pa.binary())],
                    ["segment", "once", "twice"],
                )

        for part in slices(batches):
            for text in part.column("text").to_pylist():
                held.extend(xxhash.xxh3_64_intdigest(k) for k in keys_of(text, min_chars))
            if len(held) > BUFFERED_KEYS:
                yield from flush()
                held.clear()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments one after the other, parts one at a time."""
        current, once, twice = None, None, None

        def result():
            raw = zlib.compress(twice.tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([raw], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for s, a, b in zip(*[batch.column(c).to_pylist() for c in ("segment", "once", "twice")]):
                new = np.frombuffer(zlib.decompress(a), np.uint8)
                again = np.frombuffer(zlib.decompress(b), np.uint8) if b else np.zeros_like(new)
                if s != current:
                    if current is not None:
                        yield result()
                    current, once, twice = s, new, again
                else:
                    twice = twice | again | (once & new)
                    once = once | new
        if current is not None:
            yield result()

    found = docs.select("text").mapInArrow(parts, "segment long, once binary, twice binary")
    merged = found.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, twice binary")
    return assembled(merged, "twice", bits)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without the lines whose key ``min_docs`` documents have, but for the largest doc_id that has it.

    Columns as in ``docs``, then n_lines (before) and n_dropped."""
    if min_docs < 2:
        raise ValueError("min_docs must be at least 2")
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bits = power_of_two(BITS_PER_LINE * (n_lines or 0), 1 << 10, MAX_BITS)
    twice = spark.sparkContext.broadcast(twice_seen(docs, min_chars, bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, keys = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                own = keys_of(text, min_chars)
                keys.extend(own)
                rows.extend([i] * len(own))
            hit = contains(twice.value, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64))
            kept = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(np.array(rows, dtype=np.int64)[kept])), pa.array([keys[i] for i in kept], pa.binary())],
                ["doc_id", "key"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    suspects = materialize(docs.select("doc_id", "text").mapInArrow(suspected, f"doc_id {kind}, key binary"), "suspects")
    repeated = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    lost = suspects.join(repeated.drop("n"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id").agg(F.collect_set("key").alias("_lost")).withColumnRenamed("doc_id", "_doc")
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    schema = extended(docs.schema, "n_lines long, n_dropped long")
    at = docs.columns.index("text")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, total, gone = [], [], []
            for text, lost in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                n = (text or "").count("\n") + 1
                if lost:
                    lost = set(lost)
                    lines = [x for x in text.encode().split(b"\n") if line_key(x) not in lost]
                    text = b"\n".join(lines).decode()
                    gone.append(n - len(lines))
                else:
                    gone.append(0)
                texts.append(text)
                total.append(n)
            columns = part.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return joined.mapInArrow(rebuilt, schema)
