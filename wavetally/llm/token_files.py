"""Token id files with Elias-Fano document boundaries.

A shard file holds the ids of consecutive documents one after the other. Where
documents end, and which doc_ids they have, are two non-decreasing sequences;
each is kept as an Elias-Fano code of about 2 + log2(range / documents) bits per
document with sampled select, instead of a table of 64-bit numbers. The end of
document ``i`` is found by selecting the ``i``-th set bit of the high half.

File layout, little-endian: magic, then a header of ``HEADER``, then the code of
the ends, the code of the doc_ids, and the ids in the smallest of 1, 2 or 4
bytes that holds the vocabulary. A shard stands for itself: it can be written
again by a retried task with the same content, and read without the others.

Documents are in ascending order of doc_id over all shards; rows of one doc_id
in order of their ids' bytes and in one shard. Rows without doc_id come first and are counted in
the header. A null text is the end id alone. An empty table makes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from wavetally.llm.common import slices
from wavetally.llm.tokens import word_encoder
from wavetally.sources.recording import file_system

MAGIC = b"EFTOK001"
HEADER = "<QQqBQQ"  # documents, documents without doc_id, least doc_id, bytes per id, two code lengths
CODE = "<QQB"  # values, upper bound, low bits
SAMPLE = 512
SHARD_CHARS = 24 << 20
MANIFEST = "shard long, path string, documents long, tokens long"


class EliasFano:
    """Non-decreasing values below or at ``top``: low bits packed, high bits in unary, select by sampled ranks."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.top, self.low_bits = n, top, low_bits
        self.low, self.high = low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        self.before = np.concatenate([[0], ones[SAMPLE - 1 :: SAMPLE]])  # set bits before every block of SAMPLE bytes

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, (int(top) // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(top) >> low_bits) + n + 1, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, int(top), low_bits, low, np.packbits(bits, bitorder="little"))

    def select(self, i: int) -> int:
        """The ``i``-th value, touching one block of the high half."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        part = np.unpackbits(self.high[block * SAMPLE : (block + 1) * SAMPLE], bitorder="little")
        at = block * SAMPLE * 8 + int(np.flatnonzero(part)[i - self.before[block]])
        return ((at - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first, out = i * self.low_bits, 0
        raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        out = (raw >> (first % 8)) & ((1 << self.low_bits) - 1)
        return out

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high | low

    def tobytes(self) -> bytes:
        return struct.pack(CODE, self.n, self.top, self.low_bits) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, raw: memoryview) -> EliasFano:
        n, top, low_bits = struct.unpack_from(CODE, raw)
        at = struct.calcsize(CODE) + (n * low_bits + 7) // 8
        low = np.frombuffer(raw[struct.calcsize(CODE) : at], np.uint8)
        return cls(n, top, low_bits, low, np.frombuffer(raw[at:], np.uint8))


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, id_bytes: int) -> bytes:
    """A shard file of documents in order; ``ids``: all of them in ``id_bytes`` bytes each."""
    known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum(lengths), int(np.sum(lengths))).tobytes()
    keys = (known - least).astype(np.uint64)
    names = EliasFano.encode(keys, int(keys[-1]) if len(keys) else 0).tobytes()
    header = struct.pack(HEADER, len(doc_ids), len(doc_ids) - len(known), least, id_bytes, len(ends), len(names))
    return b"".join([MAGIC, header, ends, names, ids])


class Shard:
    """A shard file in memory; documents by number."""

    def __init__(self, raw: bytes):
        raw = memoryview(raw)
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token id file")
        at = len(MAGIC)
        self.documents, self.unnamed, self.least, self.id_bytes, ends, names = struct.unpack_from(HEADER, raw, at)
        at += struct.calcsize(HEADER)
        self.ends = EliasFano.frombytes(raw[at : at + ends])
        self.names = EliasFano.frombytes(raw[at + ends : at + ends + names])
        self.ids = np.frombuffer(raw[at + ends + names :], f"<u{self.id_bytes}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.names.select(i - self.unnamed) + self.least

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.ids[a:b].astype("<u4")


def _bounds(docs: DataFrame, shard_chars: int) -> list[int]:
    """First doc_id of every shard but the first, so that shards hold about ``shard_chars`` of text."""
    sizes = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    shards = -(-(sizes[0] or 0) // shard_chars)
    if shards < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100_000)).first()[0]
    return sorted(set(cuts or []))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encode and write all documents below ``path``; a row per shard: shard, path, documents, tokens.

    Texts are encoded where they are read; ids move once, to the shard their doc_id falls into."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for part in slices(batches):
            ids = [np.frombuffer(encoder.encode(t or "") + end, "<u4").astype(f"<u{wide}").tobytes() for t in part.column("text").to_pylist()]
            place = np.searchsorted(bounds.value, np.asarray(part.column("doc_id").fill_null(lowest)), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(place), part.column("doc_id"), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        names = table.column("doc_id").to_pylist()
        held = table.column("ids").to_pylist()
        nulls = sum(x is None for x in names)
        names, held = names[len(names) - nulls :] + names[: len(names) - nulls], held[len(held) - nulls :] + held[: len(held) - nulls]
        lengths = np.array([len(x) // wide for x in held], dtype=np.int64)
        raw = pack_shard(names, lengths, b"".join(held), wide)
        filesystem, folder = file_system(path)
        filesystem.create_dir(folder, recursive=True)
        name = f"{folder.rstrip('/')}/ids-{number:08d}.eft"
        with filesystem.open_output_stream(name) as f:
            f.write(raw)
        return pa.table(
            [pa.array([number]), pa.array([name]), pa.array([len(names)]), pa.array([int(lengths.sum())])],
            ["shard", "path", "documents", "tokens"],
        )

    wide = id_width(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lowest = np.iinfo(np.int64).min
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(_bounds(rows, shard_chars), dtype=np.int64))
    return rows.mapInArrow(encode, "shard long, doc_id long, ids binary").groupBy("shard").applyInArrow(shard, MANIFEST)


def id_width(vocabulary: int, end_id: int) -> int:
    top = max(vocabulary - 1, end_id)
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``manifest``: the rows that ``write`` gave, one per shard; the running sum of their tokens is where shards start."""
    sizes = manifest.orderBy("shard").select("shard", "tokens").collect()  # a row per shard of some 24 MB
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not sizes:
        return spark.createDataFrame([], schema)
    starts = dict(zip([r[0] for r in sizes], np.concatenate([[0], np.cumsum([r[1] for r in sizes])]).tolist()))
    shared = spark.sparkContext.broadcast(starts)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                s = Shard(raw.as_buffer())
                first = shared.value[int(name.rpartition("-")[2].removesuffix(".eft"))]
                ends = s.ends.values().astype(np.int64)
                begins = np.append(0, ends[:-1])
                names = [None] * s.unnamed + (s.names.values().astype(np.int64) + s.least).tolist()
                wide = s.ids
                crc = [zlib.crc32(wide[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(begins + first), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(path).select("path", "content")
    return files.mapInArrow(documents, schema)
