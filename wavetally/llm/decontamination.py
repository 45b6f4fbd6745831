"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment of words.

The score of an alignment is its share of the best possible one, so replaced,
dropped and added words lower it a little each. Seeds are complete for it: take an
alignment of m of an item's n words with score 2m - p >= 2tn, t the threshold and p
the penalties. Of its m - 1 steps from a match to the next, those with two or more
penalties are at most p / 2 <= m - tn. The others, at least tn - 1, have one at
most, so they lead one or two words on in the item and in the document. So at
least ceil(tn) - 1 of the item's n - 1 first places of pairs (words one or two
apart) occur in the document, one or two words apart; among all but
ceil(tn) - 2 places, whichever are chosen, one does. Chosen are the places whose
pairs are rarest in the training documents, so seeds are as rare as the item
allows. The alignment lies within p <= 2n(1 - t) words of the seed's diagonal;
this passage is counted for places of pairs, and aligned if there are enough.

Items are broadcast, with their words bounded by ``MAX_ITEM_WORDS`` (checked);
documents never move.

Defined results: words are runs of letters and digits (and non-ASCII bytes) with
A-Z lower-cased; a null text has no leak; a null or short item (fewer than
``MIN_WORDS`` words) matches nothing; equal items are reported each; per
document and item the best alignment counts, of equal ones the first; rows repeat
as in the input and all columns pass through (a column named as the result's is
replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.llm.common import mix64, power_of_two, slices
from wavetally.llm.words import PUNCTUATION, Words

MIN_WORDS = 3
STEPS = (1, 2)  # how far apart the words of a pair are
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
MAX_ITEM_WORDS = 5_000_000
LEAK = "item_id long, similarity double, doc_start long, doc_end long, item_start long, item_end long"


def pairs(words: np.ndarray, step: int) -> np.ndarray:
    """Hashes of every word with the one ``step`` words on."""
    return mix64(words[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ words[step:])


def least_places(n: int, threshold: float) -> int:
    """How many first places of pairs of an item of ``n`` words an alignment of that score has in common with the text."""
    return math.ceil(threshold * n - 1e-9) - 1


class Items:
    """Benchmark items as word hashes, and the pairs of words they are made of."""

    def __init__(self, ids: list, words: list[np.ndarray]):
        self.ids, self.words = ids, words
        of, at, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, w in enumerate(words):
            for step in STEPS if len(w) >= MIN_WORDS else ():
                gram.append(pairs(w, step))
                at.append(np.arange(len(w) - step))
                of.append(np.full(len(w) - step, i))
        self.of, self.at, self.gram = np.concatenate(of), np.concatenate(at), np.concatenate(gram)

    def seeds(self, grams: np.ndarray, frequency: np.ndarray, threshold: float) -> Items:
        """With only the places of rarest pairs, as many as an alignment of that score cannot miss; ``frequency`` of sorted ``grams``."""
        out = Items.__new__(Items)
        out.ids, out.words = self.ids, self.words
        counts = frequency[np.searchsorted(grams, self.gram)]
        first = np.cumsum([0, *[len(w) for w in self.words]])
        place = first[self.of] + self.at  # among all items' words
        keep = np.zeros(first[-1], dtype=bool)
        rank = np.zeros(first[-1], dtype=np.int64)
        np.add.at(rank, place, counts)
        for a, w in zip(first.tolist(), self.words):
            n = len(w)
            if n >= MIN_WORDS:
                keep[a + np.argsort(rank[a : a + n - 1], kind="stable")[: n - least_places(n, threshold)]] = True
        kept = keep[place]
        out.of, out.at, out.gram = self.of[kept], self.at[kept], self.gram[kept]
        return out

    def sorted(self) -> Items:
        order = np.argsort(self.gram, kind="stable")
        self.of, self.at, self.gram = self.of[order], self.at[order], self.gram[order]
        return self


def hits(grams: np.ndarray, wanted: np.ndarray, quick: np.ndarray) -> np.ndarray:
    """Places of ``grams`` that are among the sorted ``wanted``; ``quick``: flags by the lower hash bits."""
    at = np.flatnonzero(quick[grams & np.uint64(len(quick) - 1)])
    found = np.searchsorted(wanted, grams[at])
    found[found == len(wanted)] = 0
    return at[wanted[found] == grams[at]] if len(wanted) else at[:0]


def quick_flags(wanted: np.ndarray) -> np.ndarray:
    flags = np.zeros(power_of_two(8 * len(wanted), 1 << 20, 1 << 26), dtype=bool)
    flags[wanted & np.uint64(len(flags) - 1)] = True
    return flags


def found_pairs(w: Words, wanted: np.ndarray, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs within a text that are ``wanted``: text, place among all words and hash, in order of place; and the words' hashes."""
    h = w.hashes(lower=True)
    places, grams = [], []
    for step in STEPS:
        g = pairs(h, step)
        at = hits(g, wanted, quick)
        at = at[at + step < w.first[np.searchsorted(w.first, at, side="right")]]
        places.append(at)
        grams.append(g[at])
    at, g = np.concatenate(places), np.concatenate(grams)
    order = np.argsort(at, kind="stable")
    at, g = at[order], g[order]
    return np.searchsorted(w.first, at, side="right") - 1, at, g, h


def _best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Score and end (in a, in b) of the best local alignment; of equal ones the first by a's end, then b's."""
    steps = GAP * np.arange(len(b) + 1)
    above = np.zeros(len(b) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, w in enumerate(a):
        now = np.empty_like(above)
        now[0] = 0
        np.maximum(above[:-1] + np.where(b == w, MATCH, MISMATCH), above[1:] + GAP, out=now[1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now - steps) + steps  # gaps along b
        j = int(now.argmax())
        if now[j] > best[0]:
            best = (int(now[j]), i + 1, j)
        above = now
    return best


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment: score, start and end in ``a``, start and end in ``b``."""
    score, end_a, end_b = _best_end(a, b)
    if not score:
        return 0, 0, 0, 0, 0
    _, back_a, back_b = _best_end(a[:end_a][::-1], b[:end_b][::-1])
    return score, end_a - back_a, end_a, end_b - back_b, end_b


def _passages(of: np.ndarray, diagonal: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the stretches of a document that seeds point to, overlapping ones joined."""
    order = np.lexsort((diagonal, of))
    item, start, end = -1, 0, 0
    for i, d in zip(of[order].tolist(), diagonal[order].tolist()):
        n = len(items.words[i])
        wide = int(MATCH * n * (1 - threshold)) + 1
        a, b = d - wide, d + n + wide
        if i == item and a <= end:
            end = max(end, b)
            continue
        if item >= 0:
            yield item, start, end
        item, start, end = i, a, b
    if item >= 0:
        yield item, start, end


def leaks_in(words: np.ndarray, found: np.ndarray, grams: np.ndarray, items: Items, threshold: float) -> list[dict]:
    """Items leaked into one document; ``found``: places of seeds in it, ``grams``: their hashes."""
    lo = np.searchsorted(items.gram, grams, side="left")
    n = np.searchsorted(items.gram, grams, side="right") - lo
    entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    best: dict[int, dict] = {}
    for i, a, b in _passages(items.of[entry], np.repeat(found, n) - items.at[entry], items, threshold):
        own, a = items.words[i], max(a, 0)
        passage = words[a:b]
        least = threshold * MATCH * len(own)
        if MATCH * np.isin(own, passage).sum() < least:  # no alignment can score more
            continue
        there = np.concatenate([pairs(passage, step) for step in STEPS])
        common = np.isin(pairs(own, 1), there)
        common[:-1] |= np.isin(pairs(own, 2), there)
        if common.sum() < least_places(len(own), threshold):
            continue
        score, item_start, item_end, start, end = align(own, passage)
        if score >= least and score / (MATCH * len(own)) > best.get(i, {"similarity": -1})["similarity"]:
            best[i] = {
                "item_id": items.ids[i],
                "similarity": score / (MATCH * len(own)),
                "doc_start": a + start,
                "doc_end": a + end,
                "item_start": item_start,
                "item_end": item_end,
            }
    return [best[i] for i in sorted(best)]


def load_items(benchmark: DataFrame, max_words: int = MAX_ITEM_WORDS) -> Items:
    """The items on the driver, their size counted first."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    size = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    if size > max_words:
        raise ValueError(f"{size} benchmark words exceed the {max_words} that may be broadcast; run it in parts")
    table = rows.orderBy("item_id", "text").toArrow()
    w = Words(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), PUNCTUATION)
    h = w.hashes(lower=True)
    return Items(table.column("item_id").to_pylist(), [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])])


def gram_frequency(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each of the benchmark's pairs occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = shared.value, np.zeros(len(shared.value), dtype=np.int64)
        quick = quick_flags(grams)
        for part in slices(batches):
            text, _, g, _ = found_pairs(Words(part.column("text"), PUNCTUATION), grams, quick)
            once = np.unique(text * len(grams) + np.searchsorted(grams, g))
            total += np.bincount(once % len(grams), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["gram", "n"])

    if not len(wanted):
        return np.zeros(0, np.int64)
    rows = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(wanted), dtype=np.int64)
    out[np.asarray(rows.column("gram"))] = np.asarray(rows.column("n"))
    return out


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``leaks``, an array with the best alignment of every item found in the text."""
    if least_places(MIN_WORDS, threshold) < 1:
        raise ValueError(f"threshold {threshold} is too low: an alignment of {MIN_WORDS} words must have a pair in common")
    items = load_items(benchmark)
    grams = np.unique(items.gram)
    seeds = items.seeds(grams, gram_frequency(docs, grams), threshold).sorted()
    shared = docs.sparkSession.sparkContext.broadcast((seeds.ids, seeds.words, seeds.of, seeds.at, seeds.gram))
    docs = docs.drop("leaks")
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", T.ArrayType(T.StructType.fromDDL(LEAK)))])
    kind = pa.list_(pa.struct([(n, pa.float64() if n == "similarity" else pa.int64()) for n in LEAK.replace(",", "").split()[::2]]))
    at_text = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.__new__(Items)
        items.ids, items.words, items.of, items.at, items.gram = shared.value
        quick = quick_flags(items.gram)
        for part in slices(batches):
            w = Words(part.column(at_text), PUNCTUATION)
            text, at, g, h = found_pairs(w, items.gram, quick)
            found: list[list] = [[] for _ in range(len(w))]
            edges = np.flatnonzero(np.append(True, np.diff(text) != 0)) if len(text) else []
            for a, b in zip(edges, [*edges[1:], len(text)]):
                i = int(text[a])
                lo, hi = w.first[i], w.first[i + 1]
                found[i] = leaks_in(h[lo:hi], at[a:b] - lo, g[a:b], items, threshold)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], schema.names)

    return docs.mapInArrow(scan, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents into which no item leaked."""
    return with_leaks(docs, benchmark, threshold).where(F.size("leaks") == 0).drop("leaks")
