"""Token counts per section: every document is encoded once, its tokens are attributed by their offsets.

A document is its fields one after the other, and is encoded whole, as it would be
for training. A byte-level vocabulary keeps every byte, so that the running sum of
its tokens' byte lengths gives their spans. Spans meet the sections' spans in an
interval join of two sorted lists. A token that reaches over a section's end is
allocated by a rule:

* ``first``: to the section of its first byte,
* ``last``: to the section of its last byte,
* ``largest``: to the section that has most of its bytes, of equal ones the first.

Whatever the rule, the sections' counts sum up to the document's.

Defined results: a null field is empty; an empty section has no token; an empty
document has none; rows repeat as in the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import slices
from wavetally.llm.tokens import WordEncoder

RULES = ("first", "last", "largest")


def byte_lengths(encoder: WordEncoder) -> np.ndarray:
    """Bytes that each id stands for: one per character of a byte-level token, the text itself for added tokens."""
    if not encoder.blanks_lead:
        raise ValueError("offsets need a byte-level vocabulary that keeps all bytes")
    out = np.zeros(encoder.tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in encoder.tokenizer.get_vocab().items():
        out[i] = len(token)
    for i, added in encoder.tokenizer.get_added_tokens_decoder().items():
        out[i] = len(added.content.encode())
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and tokens over a section's end. Section ``k`` is bounds[k]:bounds[k + 1], bounds ascending."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    chosen = last if rule == "last" else first.copy()
    if rule == "largest":
        for i in crossing.tolist():
            edges = np.clip(bounds[first[i] : last[i] + 2], starts[i], ends[i])
            chosen[i] = first[i] + int(np.diff(edges).argmax())
    return np.bincount(chosen, minlength=len(bounds) - 1), len(crossing)


def count_tokens(docs: DataFrame, fields: Sequence[str], tokenizer_path: str, rule: str = "first", title: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_crossing and tokens_<section> for every field.

    ``title``: a field whose first line (with its line end) is a section of its own, tokens_title, before the rest of it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [n for f in fields for n in (("title", f) if f == title else (f,))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        lengths = byte_lengths(encoder)
        for part in slices(batches, fields[-1]):
            columns = [part.column(f).to_pylist() for f in fields]
            total = np.zeros(part.num_rows, dtype=np.int64)
            crossed = np.zeros(part.num_rows, dtype=np.int64)
            found = np.zeros((len(names), part.num_rows), dtype=np.int64)
            for i, values in enumerate(zip(*columns)):
                sections = []
                for f, v in zip(fields, values):
                    v = v or ""
                    cut = v.find("\n") + 1 or len(v)
                    sections.extend([v[:cut], v[cut:]] if f == title else [v])
                ids = np.frombuffer(encoder.encode("".join(sections)), "<u4")
                ends = np.cumsum(lengths[ids])
                bounds = np.concatenate([[0], np.cumsum([len(s.encode()) for s in sections])])
                if len(ids) and ends[-1] != bounds[-1]:
                    raise ValueError("token spans do not add up to the text")
                found[:, i], crossed[i] = attribute(ends - lengths[ids], ends, bounds, rule)
                total[i] = len(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total), pa.array(crossed), *[pa.array(x) for x in found]],
                ["doc_id", "n_tokens", "n_crossing", *[f"tokens_{n}" for n in names]],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", *[F.col(f).cast("string").alias(f) for f in fields])
    return wanted.mapInArrow(count, ", ".join([f"doc_id {kind}", "n_tokens long", "n_crossing long", *[f"`tokens_{n}` long" for n in names]]))
