"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter per language would need one lookup per language. Here every
filter position holds a mask with one bit per language, so that the AND of the
``HASHES`` masks of an n-gram gives all languages that contain it at once. A
text's language is the one with most n-grams after each language's count is
corrected for the false positives its filter yields by chance.

N-grams are byte 3- to 5-grams of the text with A-Z lower-cased and everything
but letters and non-ASCII bytes taken as a blank; none reaches over a blank.

Which n-grams enter a language's filter depends on shares only, never on
absolute counts: at least ``MIN_SHARE`` of the language's n-grams (which bounds
a filter at 1 / MIN_SHARE entries, whatever the size of the corpus) and at least
``MIN_RELATIVE`` of the largest share it has in any language (which keeps out
n-grams of quotations).

Defined results: a text that is null or has no letter is ``und`` with score 0;
without anything to learn from, all are. A text whose n-grams no language knows
gets the first language in order with score 0, as do ties. Rows repeat as in the
input. Rows without doc_id count as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import as_long, extended, mix64, power_of_two, slices
from wavetally.llm.words import utf8

SIZES = (3, 4, 5)
HASHES = 4
BITS_PER_ENTRY = 16
MIN_SHARE = 2e-6
MIN_RELATIVE = 0.1
UNKNOWN = "und"
MERGE_AT = 2_000_000
# Text handled at once: the arrays of its n-grams, some 20 times its size each, stay in the processor's cache.
CACHED_BYTES = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def text_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts, packed into 64 bits, and the text each is of.

    Texts are set apart by a blank; a blank may begin or end an n-gram, not lie inside one."""
    data, at = utf8(column)
    n_texts = len(at) - 1
    owner = np.repeat(np.arange(n_texts), np.diff(at) + 1)
    inside = np.ones(len(data) + n_texts + 1, dtype=bool)
    inside[at + np.arange(n_texts + 1)] = False
    spread = np.full(len(inside), 32, dtype=np.uint64)
    spread[inside] = _CLASS[data]
    blank = spread == 32
    grams, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    packed, crossed = spread, np.zeros(len(spread), dtype=bool)
    for n in range(2, min(max(SIZES), len(spread)) + 1):
        packed = (packed[:-1] << np.uint64(8)) | spread[n - 1 :]  # of n bytes each
        last = blank[n - 1 :]
        if n in SIZES:
            keep = np.flatnonzero(~(crossed[: len(last)] | (blank[: len(last)] & last)))
            grams.append(packed[keep] | np.uint64(n << 8 * n))
            owners.append(owner[keep])
        crossed = crossed[: len(last)] | last  # a blank after the first byte
    return np.concatenate(grams), np.concatenate(owners)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) with the counts of the task, in parts of bounded size."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            for a in range(0, len(keys), 100_000):
                k, c = keys[a : a + 100_000], counts[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(as_long(k)), pa.array(c)], ["lang", "gram", "n"]
                )

    for part in slices(batches, limit=CACHED_BYTES):
        for lang in pc.unique(part.column("lang")).to_pylist():
            grams, _ = text_grams(part.filter(pc.equal(part.column("lang"), lang)).column("text"))
            keys, counts = np.unique(grams, return_counts=True)
            held.setdefault(lang, []).append((keys, counts))
            size += len(keys)
        if size > MERGE_AT:
            for lang, parts in held.items():
                held[lang] = [_summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
            size = sum(len(k) for parts in held.values() for k, _ in parts)
            if size > MERGE_AT:
                yield from flush()
                held, size = {}, 0
    yield from flush()


@dataclass(frozen=True)
class Model:
    """``slices[p]``: bit ``i`` is set when position ``p`` of the filter of ``languages[i]`` is."""

    languages: list[str]
    slices: np.ndarray
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per n-gram the languages that contain it."""
        out = None
        for p in _positions(grams, len(self.slices)):
            found = self.slices[p]
            out = found if out is None else out & found
        return out


def _positions(grams: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """The ``HASHES`` positions of every n-gram, as the signed integers that numpy looks up without a copy."""
    h = mix64(grams)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (h & np.uint64(m - 1)).view(np.int64)
        if i + 1 < HASHES:
            h = h + step


def _mask_type(languages: int):
    for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)):
        if languages <= bits:
            return t
    raise ValueError("at most 64 languages to a filter")


def gram_counts(docs: DataFrame) -> DataFrame:
    """Per n-gram a map from each language that has it to the times: the few languages of an n-gram side by side.

    One shuffle by n-gram serves both sums; a task's counts are already sums."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").repartition("gram")
    counts = counts.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    return counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))


def train(docs: DataFrame, min_share: float = MIN_SHARE, min_relative: float = MIN_RELATIVE) -> Model:
    """Learn from the rows of ``docs`` that have a text and a lang.

    Counting runs over all rows; what reaches the driver is bounded by 1 / ``min_share`` n-grams per language."""
    per_gram = gram_counts(docs).persist()
    totals = {
        r["lang"]: r["n"]
        for r in per_gram.select(F.explode("n").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    }
    languages = sorted(totals)
    if not languages:
        per_gram.unpersist()
        return Model([], np.zeros(1, np.uint8), np.zeros(0))
    share = F.array(*[F.coalesce(F.col("n")[x], F.lit(0)) / F.lit(float(totals[x])) for x in languages])
    kept = per_gram.select("gram", share.alias("share")).withColumn("least", F.greatest(F.lit(min_share), min_relative * F.array_max("share")))
    within = F.transform("share", lambda s: s >= F.col("least"))
    kept = kept.select("gram", within.alias("within")).where(F.exists("within", lambda x: x)).toArrow()
    per_gram.unpersist()
    grams = np.asarray(kept.column("gram")).view(np.uint64)
    within = np.asarray(kept.column("within").combine_chunks().flatten(), dtype=bool).reshape(-1, len(languages))
    m = power_of_two(BITS_PER_ENTRY * max(1, int(within.sum(axis=0).max(initial=0))), 1 << 10, 1 << 26)
    cells = np.zeros(m, dtype=_mask_type(len(languages)))
    fill = np.zeros(len(languages))
    for i in range(len(languages)):
        bit = cells.dtype.type(1 << i)
        for p in _positions(grams[within[:, i]], m):
            cells[p] |= bit
        fill[i] = np.count_nonzero(cells & bit) / m
    return Model(languages, cells, fill**HASHES)


def identify(docs: DataFrame, model: Model, returned: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, the corrected share of n-grams the language knows.

    ``returned``: the columns of ``docs`` to give back, all by default; texts left out do not travel back from Python."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.slices, model.false_rate))  # plain types: tasks lack this package
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    back = keep if returned is None else returned
    schema = extended(docs.select(*[F.col(f"`{c}`") for c in back]).schema, "lang_pred string, score double")
    at = [keep.index(c) for c in back]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in slices(batches, limit=CACHED_BYTES):
            texts = part.column(part.schema.get_field_index("text"))
            lang, score = _decide(m, texts)
            columns = [*[part.column(i) for i in at], pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*back, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(predict, schema)


def _hits(masks: np.ndarray, owner: np.ndarray, n_texts: int, languages: int) -> np.ndarray:
    """Per text and language the n-grams that have the language's bit: one count of (text, bits) for eight languages."""
    hits = []
    for first in range(0, languages, 8):
        bits = (masks >> masks.dtype.type(first)) & masks.dtype.type(255)
        per_text = np.bincount(owner * 256 + bits.astype(np.int64), minlength=n_texts * 256).reshape(n_texts, 256)
        hits.append(per_text @ ((np.arange(256)[:, None] >> np.arange(8)) & 1))
    return np.concatenate(hits, axis=1)[:, :languages]


def _decide(m: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    n_texts = len(texts)
    lettered = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
    if not m.languages:
        return [UNKNOWN] * n_texts, np.zeros(n_texts)
    grams, owner = text_grams(texts)
    total = np.bincount(owner, minlength=n_texts)
    hits = _hits(m.masks(grams), owner, n_texts, len(m.languages))
    known = np.clip((hits - total[:, None] * m.false_rate) / (1 - m.false_rate), 0, None)
    best = known.argmax(axis=1)
    score = known[np.arange(n_texts), best] / np.maximum(total, 1)
    score = np.where(lettered, np.clip(score, 0.0, 1.0), 0.0)
    return [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


def held_out(folds: int = 5):
    """Column: the row is no training row of the fixed split."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(True))
