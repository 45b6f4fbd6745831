"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 low quality, 1 good but toxic, 2 good. One weight vector w
over hashed features is shared by all grades, and ordered thresholds t0 < t1 cut
its scale: P(grade <= k) = logistic(t_k - w x). A text gets its expected grade and
the tail probability P(grade = 2), which selects.

Features are presences: hashed lower-cased words of letters and digits, and
hashed marks for how words end or are written when that holds for a tenth of the
words or more, and for how large a share of the words is distinct. A feature enters the model only where its rate differs clearly
between grades, so that chance weights of the words of a long text cannot add up.

Fitted on a bounded sample of labelled rows: about ``MAX_ROWS`` by hash of doc_id
(all when there are fewer). Scoring reads every document.

Defined results: a label without doc_id or quality is ignored, repeated labels of
a document count as the lowest; a null text has no feature and gets the grade of
an empty text; without labels of two grades every probability is that of the
grades' shares (1 for the only one; without any label, grade 2); rows repeat as in
the input and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import extended, mix64, slices
from wavetally.llm.words import PUNCTUATION, Words

GRADES = 3
BUCKETS = 1 << 18
MAX_ROWS = 20_000
MIN_Z = 5.0
L2 = 2e-5
STEPS = 400
SELECT_AT = 0.5


def features(column: pa.Array) -> list[np.ndarray]:
    """Per text the distinct feature buckets."""
    w = Words(column, PUNCTUATION)
    words = (w.hashes(lower=True) & np.uint64(BUCKETS - 1)).astype(np.int64)
    raw = Words(column)
    last = raw.data[raw.end - 1].astype(np.int64) if len(raw.end) else np.zeros(0, np.int64)
    first = raw.data[raw.start].astype(np.int64) if len(raw.start) else np.zeros(0, np.int64)
    second = raw.data[np.maximum(raw.end - 2, raw.start)].astype(np.int64) if len(raw.end) else last
    letter = np.array([97 if chr(b).islower() or b >= 128 else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256)])
    shape = letter[last] | (letter[second] << 8) | (letter[first] << 16)
    out = []
    for a, b, c, d in zip(w.first[:-1], w.first[1:], raw.first[:-1], raw.first[1:]):
        kinds, n = np.unique(shape[c:d], return_counts=True)
        marks = mix64(kinds[10 * n >= d - c].astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(BUCKETS - 1)
        distinct = np.unique(words[a:b])
        varied = np.array([], np.uint64) if b - a < 20 else np.array([10 * len(distinct) // (b - a)], np.uint64)
        varied = mix64(varied + np.uint64(1 << 41)) & np.uint64(BUCKETS - 1)
        out.append(np.unique(np.concatenate([distinct, marks.astype(np.int64), varied.astype(np.int64)])))
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 per score."""
        z = np.clip(score[:, None] - self.thresholds[None, :], -60, 60)
        return 1 / (1 + np.exp(-z))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, width: int, steps: int = STEPS, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the negative log-likelihood, thresholds kept in order."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    index = np.concatenate(rows or [np.zeros(0, np.int64)])
    share = np.clip(np.array([(grades <= k).mean() for k in range(GRADES - 1)]), 1 / (2 * n), 1 - 1 / (2 * n))
    start = np.log(share / (1 - share))
    gap = max(start[1] - start[0], 1e-2)
    p = np.concatenate([np.zeros(width), [start[0], np.log(gap)]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        w, t0, gap = p[:width], p[width], np.exp(p[width + 1])
        s = np.bincount(owner, weights=w[index], minlength=n)
        upper = np.where(grades == 0, logistic(t0 - s), np.where(grades == 1, logistic(t0 + gap - s), 1.0))
        lower = np.where(grades == 0, 0.0, np.where(grades == 1, logistic(t0 - s), logistic(t0 + gap - s)))
        prob = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        ds = (du - dl) / prob  # of the loss by s
        at0 = np.where(grades == 0, -du, np.where(grades == 1, dl, 0.0)) / prob
        at1 = np.where(grades == 1, -du, np.where(grades == 2, dl, 0.0)) / prob
        g = np.concatenate([np.bincount(index, weights=ds[owner], minlength=width) / n + l2 * w, [(at0 + at1).mean(), at1.mean() * gap]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:width], np.array([p[width], p[width] + np.exp(p[width + 1])])


def graded(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, grade) of a sample of about ``max_rows`` labelled documents; the labels are the side of bounded size."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    share = max_rows / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "grade")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = graded(docs, labels, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents per grade and feature; feature -1 counts all."""
        total, n = np.zeros((GRADES, BUCKETS), dtype=np.int64), np.zeros(GRADES, dtype=np.int64)
        for part in slices(batches):
            for f, g in zip(features(part.column("text")), part.column("grade").to_pylist()):
                total[g, f] += 1
                n[g] += 1
        g, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(g, np.arange(GRADES)), pa.int32()), pa.array(np.append(f, [-1] * GRADES), pa.int32()), pa.array(np.append(total[g, f], n))],
            ["grade", "f", "n"],
        )

    counts = rows.mapInArrow(count, "grade int, f int, n long").groupBy("grade", "f").agg(F.sum("n").alias("n")).toArrow()
    g, f, n = (np.asarray(counts.column(c)) for c in ("grade", "f", "n"))
    size = np.zeros(GRADES, dtype=np.int64)
    size[g[f < 0]] = n[f < 0]
    if (size > 0).sum() < 2:
        only = int(size.argmax()) if size.any() else GRADES - 1
        return Model(np.zeros(BUCKETS), np.array([-60.0 if only >= 1 else 60.0, -60.0 if only >= 2 else 60.0]))
    present = np.zeros((GRADES, BUCKETS))
    present[g[f >= 0], f[f >= 0]] = n[f >= 0]
    rate = present.sum(axis=0) / size.sum()
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) / np.maximum(size, 1)[:, None])
    z = np.where(size[:, None] > 0, np.abs(present / np.maximum(size, 1)[:, None] - rate) / spread, 0).max(axis=0)
    chosen = np.flatnonzero(z >= MIN_Z)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = [np.flatnonzero(np.isin(shared.value, f, assume_unique=True)) for f in features(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([k.tolist() for k in kept], pa.list_(pa.int32()))], ["grade", "f"])

    sample = rows.mapInArrow(select, "grade int, f array<int>").toArrow()
    held = [np.array(x, dtype=np.int64) for x in sample.column("f").to_pylist()]
    weights, thresholds = fit_ordinal(held, np.asarray(sample.column("grade")), len(chosen))
    full = np.zeros(BUCKETS)
    full[chosen] = weights
    return Model(full, thresholds)


def score(docs: DataFrame, model: Model, select_at: float = SELECT_AT) -> DataFrame:
    """The documents with expected_grade, p_good = P(grade = 2) and kept = p_good >= ``select_at``."""
    docs = docs.drop("expected_grade", "p_good", "kept")
    at, names = docs.columns.index("text"), [*docs.columns, "expected_grade", "p_good"]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for part in slices(batches):
            tails = m.tails(np.array([m.weights[f].sum() for f in features(part.column(at))]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names)

    scored = docs.mapInArrow(predict, extended(docs.schema, "expected_grade double, p_good double"))
    return scored.withColumn("kept", F.col("p_good") >= select_at)
