"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. What it measured and a bit mask of
the rules it fails are stored; policies are versioned masks over the stored
bits, so that a new policy, or the effect of taking a rule out, never reads a
text again.

Defined results: a null text counts as empty; repeated rows are measured each
for itself; a document without words fails ``few_words`` and has zero in every
measurement; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import slices
from wavetally.llm.words import Words, ngrams

WINDOW = 8
SYMBOLS = b"#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shouted long"


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` holds. The bit is fixed for ever; new rules take new bits."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 25 * n_words"),
    Rule("shouting", 3, "100 * n_shouted > 50 * n_words"),
    Rule("duplicate_lines", 4, "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", 5, "word_chars < 2 * n_words"),
    Rule("long_words", 6, "word_chars > 25 * n_words"),
)


def mask(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any rule of ``hard``, or more than ``max_soft`` rules of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    max_soft: int = 0

    def keeps(self, failures: Column) -> Column:
        hard = failures.bitwiseAND(F.lit(self.hard).cast("long")) == 0
        soft = F.bit_count(failures.bitwiseAND(F.lit(self.soft).cast("long"))) <= self.max_soft
        return hard & soft


BASE = Policy("base", hard=mask("few_words", "repeated_words"))
STANDARD = Policy(
    "standard-1",
    hard=mask("few_words", "repeated_words", "symbols", "shouting"),
    soft=mask("duplicate_lines", "short_words", "long_words"),
    max_soft=1,
)


def _per_word(w: Words, flags: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[w.end] - sums[w.start]


def _per_text(w: Words, values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[w.first])


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """Words inside a window that the text has twice or more."""
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    twice = np.append(same, False) | np.append(False, same)
    if not twice.any():
        return 0
    edge = np.zeros(n_words + 1, dtype=np.int64)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    held = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(held), len(held) - len(set(held))


def measurements(column: pa.Array) -> dict[str, np.ndarray]:
    w = Words(column)
    data = w.data
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    starts_char = (data & 0xC0) != 0x80
    upper = _per_word(w, (data >= 65) & (data <= 90))
    lower = _per_word(w, (data >= 97) & (data <= 122))
    grams = ngrams(w.hashes(lower=False), WINDOW)
    repeat = [
        _repeated(grams[a : b - WINDOW + 1], b - a) if b - a > WINDOW else 0
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())
    ]
    lines = np.array([_lines(t or "") for t in column.to_pylist()], dtype=np.int64).reshape(-1, 2)
    return {
        "n_words": w.counts,
        "word_chars": _per_text(w, _per_word(w, starts_char)),
        "n_symbols": w.totals(symbol),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.array(repeat, dtype=np.int64),
        "n_lines": lines[:, 0],
        "n_shouted": _per_text(w, (upper >= 2) & (lower == 0)),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = measurements(part.column("text"))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *[pa.array(v, pa.int64()) for v in found.values()]], ["doc_id", *found]
        )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements, and ``failures``: bit ``r.bit`` is set where rule ``r`` fails."""
    found = docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return found.withColumn("failures", bits)


def apply_policy(entries: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with ``kept`` and the policy's version."""
    return entries.withColumns({"kept": policy.keeps(F.col("failures")), "policy": F.lit(policy.version)})


def ablation(entries: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule: documents that fail it, that fail nothing else, and that the policy keeps once the rule is out.

    Works on counts per distinct mask, of which there are at most 2^rules."""
    masks = entries.groupBy("failures").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    f = F.col("failures")
    stats = [
        F.struct(
            F.lit(r.name).alias("rule"),
            total(f.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("fails"),
            total(f == (1 << r.bit)).alias("fails_alone"),
            total(policy.keeps(f)).alias("kept"),
            total(policy.keeps(f.bitwiseAND(F.lit(~(1 << r.bit)).cast("long")))).alias("kept_without"),
        )
        for r in rules
    ]
    return masks.agg(F.array(*stats).alias("s")).select(F.inline("s"))
