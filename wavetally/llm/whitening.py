"""Whitening of vectors along the leading eigenvectors of their covariance, found by contour integration (FEAST).

Two passes over the vectors give exact integer sums: of the entries, and of
products around the integer next to the mean. The covariance of these is of fixed
size, and its leading eigenpairs are found on the driver:

* **Inertia.** The number of eigenvalues above a shift is the number of positive
  pivots of ``V - shift`` in a symmetric factorisation. Bisection on these counts cuts the
  wanted end of the spectrum into intervals of a few eigenvalues whose ends lie
  in gaps.
* **Contour.** For every interval, Gauss points on the half circle over it give
  complex shifts ``z``; the weighted sum of the solves ``(z - V)^-1 Y`` is ``Y``
  projected onto the interval's eigenvectors.
* **Rayleigh-Ritz** on the projected block gives Ritz pairs; those inside the interval
  are taken once their residuals are at rounding level, else the block goes round
  again.
* **Check.** The pairs found in an interval must be as many as inertia counts. If
  not, the block is enlarged; if that does not help either, it is an error, never a
  missing component.

A third pass measures the covariance of the whitened vectors, a fourth writes rows.

Defined results: a vector that is null or holds null or non-finite entries has
no row, and neither has one of another length than most vectors have (ties: the
greater length; empty vectors never count). Repeated rows count each for
itself. Components whose eigenvalue is 0 to rounding do not exist: one vector, or equal
vectors alone, give no rows, like an empty table. Other columns are ignored. An
entry of 2^36 or more is an error. Nothing depends on the split of the rows: sums are
exact and the start block is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
LARGEST = float(1 << 36)

POINTS = 16
BLOCK = 4
# Eigenvalues below this share of the trace are 0.
ZERO = 1e-12
# A Ritz pair is final when its residual is below this share of the largest eigenvalue.
RESIDUAL = 1e-13
LOOPS = 30


# ------------------------------------------------------------- eigenpairs of a small symmetric matrix


def inertia(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` above ``shift``: positive pivots of L D L^T with 1 x 1 and 2 x 2 pivots (Bunch-Kaufman)."""
    a = v - shift * np.eye(len(v))
    above, k, n = 0, 0, len(a)
    alpha = (1 + np.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max() if len(column) else 0.0
        two = False
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(column.argmax())
            other = np.abs(a[k:, r])
            other[r - k] = 0
            sigma = other.max()
            if abs(a[k, k]) * sigma < alpha * most * most:
                if abs(a[r, r]) >= alpha * sigma:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            d = a[k : k + 2, k : k + 2].copy()
            det, trace = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0], d[0, 0] + d[1, 1]
            above += 1 if det < 0 else 2 * (trace > 0)
            below = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(d, below.T)
            k += 2
        else:
            above += a[k, k] > 0
            if a[k, k] != 0:
                below = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(below, below / a[k, k])
            k += 1
    return int(above)


def intervals(v: np.ndarray, wanted: int, block: int = BLOCK) -> list[tuple[float, float, int]]:
    """Disjoint intervals (from, to, eigenvalues inside), falling, that hold the ``wanted`` largest eigenvalues.

    Each holds at most ``block`` unless eigenvalues lie too close together to be told apart; then it holds all of those."""
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-6)
    if high == 0:
        return []
    floor = ZERO * float(np.trace(v))
    least = high * 1e-10
    counts: dict[float, int] = {high: 0}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = inertia(v, s)
        return counts[s]

    out, top = [], high
    wanted = min(wanted, above(floor))
    while above(top) < wanted:
        done = above(top)
        # the end of the interval: below the next eigenvalue, above the one that would be too many
        low, high_side = floor, top
        while above(low) - done > block and high_side - low > least:
            middle = (low + high_side) / 2
            if above(middle) - done == 0:
                high_side = middle
            else:
                low = middle
        cut = _in_gap(above, floor, low, done)
        out.append((cut, top, above(cut) - done))
        top = cut
    return out


def _in_gap(above, floor: float, low: float, done: int) -> float:
    """A shift with as many eigenvalues above as ``low`` has, in the middle of the gap below them."""
    if low <= floor:
        return floor
    inside, step = low, (low - floor) / 2
    probe = low - step
    while step > 1e-3 * (low - floor):
        if above(probe) == above(low):
            inside = probe
            probe -= step / 2
        else:
            probe += step / 2
        step /= 2
    return (low + inside) / 2


def _half_circle(low: float, high: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Shifts on the upper half of the circle over [low, high] and their weights; the lower half is its mirror image."""
    node, weight = np.polynomial.legendre.leggauss(points)
    angle = np.pi / 2 * (1 - node)
    radius = (high - low) / 2
    turn = np.exp(1j * angle)
    return (low + high) / 2 + radius * turn, weight * radius * turn / 2


def feast(v: np.ndarray, low: float, high: float, count: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high], falling, or an error if they cannot all be had."""
    n = len(v)
    shifts, weights = _half_circle(low, high, points)
    scale = np.abs(v).sum(axis=1).max()
    for size in (min(n, count + count // 2 + 3), min(n, 3 * count + 8), n):
        y = np.random.default_rng(size).standard_normal((n, size))
        for _ in range(LOOPS):
            projected = sum((w * np.linalg.solve(z * np.eye(n) - v, y)).real for z, w in zip(shifts, weights))
            u, s, _ = np.linalg.svd(projected, full_matrices=False)
            q = u[:, s > s[0] * 1e-14] if s[0] > 0 else u
            q = np.linalg.qr(q)[0]
            e, ritz = np.linalg.eigh(q.T @ v @ q)
            x = q @ ritz
            inside = (e > low) & (e <= high)
            residual = np.linalg.norm(v @ x[:, inside] - x[:, inside] * e[inside], axis=0)
            if inside.sum() == count and (residual <= RESIDUAL * scale * np.sqrt(n)).all():
                return e[inside][::-1], x[:, inside][:, ::-1]
            y = x
    raise ArithmeticError(f"{int(inside.sum())} eigenvalues found between {low} and {high}, inertia counts {count}")


def leading_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above 0, falling, and their unit eigenvectors as columns."""
    found = [feast(v, *i) for i in intervals(v, wanted)]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    # blocks of neighbouring intervals are at right angles but for rounding; one more Rayleigh-Ritz step makes them so
    q = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))[0]
    e, ritz = np.linalg.eigh(q.T @ v @ q)
    return e[::-1][:wanted], (q @ ritz)[:, ::-1][:, :wanted]


# ------------------------------------------------------------- passes over the vectors

WIDE = pa.decimal128(38, 0)


def usable(batch: pa.RecordBatch, column: str, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and scaled integer vectors of a batch, per length (or of one length only)."""
    lists = batch.column(column)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for w in [width] if width is not None else np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == w)
        if not w or not len(rows):
            continue
        flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
        c = flat.to_numpy(zero_copy_only=False).reshape(len(rows), w)  # null entries become NaN
        fine = np.isfinite(c).all(axis=1)
        c = c[fine]
        if len(c) and np.abs(c).max() >= LARGEST:
            raise ValueError("an entry is too large to be scaled exactly")
        if len(c):
            yield rows[fine], np.floor(c * SCALE).astype(np.int64) + SHIFT


def _as_sums(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of whole numbers, the last of which may have 38 digits."""
    *keys, sums = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(sums, WIDE)], names)


def integer_sums(vectors: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums per dimension, of the length that most vectors have."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in usable(batch, column):
                w = x.shape[1]
                n[w] = n.get(w, 0) + len(rows)
                sums[w] = sums.get(w, 0) + x.sum(axis=0).astype(object)
        for w, total in sums.items():
            yield _as_sums([(w, i, n[w], s) for i, s in enumerate(total.tolist())], ["width", "i", "n", "s"])

    parts = vectors.select(column).mapInArrow(partial, "width long, i long, n long, s decimal(38,0)")
    # the widest sums are as long as a vector; of the others only their counts matter
    totals = parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = totals.where("i = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).select("width")
    found = totals.join(F.broadcast(most), "width").orderBy("i").collect()
    return (int(found[0]["n"]), np.array([int(r["s"]) for r in found], dtype=object)) if found else (0, np.zeros(0, dtype=object))


def exact_covariance(vectors: DataFrame, column: str, n: int, sums: np.ndarray) -> np.ndarray:
    """The covariance (divisor n), right to the last bit but for one rounding: products are summed as integers around the
    integer next to the mean, and what that is off is taken out in fractions."""
    width = len(sums)
    centre = np.array([round(Fraction(int(s), n)) for s in sums], dtype=np.int64)
    i, j = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width), dtype=object)
        for batch in batches:
            for _, x in usable(batch, column, width):
                x = x - centre
                # doubles hold these products exactly while their sums stay below 2^53
                rows = int(2**53 // max(1, int(np.abs(x).max())) ** 2)
                if rows == 0:
                    gram += x.T.astype(object) @ x.astype(object)
                    continue
                d = x.astype(np.float64)
                for at in range(0, len(d), rows):
                    gram += (d[at : at + rows].T @ d[at : at + rows]).astype(np.int64)
        if gram.any():
            yield _as_sums(list(zip(i.tolist(), j.tolist(), gram[i, j].tolist())), ["i", "j", "s"])

    parts = vectors.select(column).mapInArrow(partial, "i long, j long, s decimal(38,0)")
    total = parts.groupBy("i", "j").agg(F.sum("s").alias("s"))
    v = np.zeros((width, width))
    off = [int(s) - n * int(c) for s, c in zip(sums, centre)]
    given = {(r["i"], r["j"]): int(r["s"]) for r in total.collect()}  # width squared / 2 numbers
    for a, b in zip(i.tolist(), j.tolist()):
        v[a, b] = v[b, a] = float(Fraction(given.get((a, b), 0) * n - off[a] * off[b], n * n))
    return v


@dataclass(frozen=True)
class Whitening:
    """Mean and leading components of a set of vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as an integer part and the rest of it."""
        whole = np.array([int(s) // self.n for s in self.sums], dtype=np.int64)
        return whole, np.array([float(Fraction(int(s) - self.n * int(w), self.n)) for s, w in zip(self.sums, whole)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre
        return ((x - whole) - rest) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening | None:
    """None if there is nothing to whiten."""
    n, sums = integer_sums(vectors, column)
    if n == 0:
        return None
    v = exact_covariance(vectors, column, n, sums)
    values, found = leading_pairs(v, components)
    return Whitening(n, sums, values, found, float(np.trace(v))) if len(values) else None


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance (around their mean) minus the identity, measured."""
    width, k = model.vectors.shape
    i, j = np.triu_indices(k)

    def means(batches):
        total = np.zeros(k)
        for batch in batches:
            for _, x in usable(batch, column, width):
                total += model.whitened(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array(total)], ["i", "s"])

    mean = np.zeros(k)
    for r in vectors.select(column).mapInArrow(means, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r["i"]] = r["s"] / model.n

    def products(batches):
        gram = np.zeros((k, k))
        for batch in batches:
            for _, x in usable(batch, column, width):
                w = model.whitened(x) - mean
                gram += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram[i, j])], ["i", "j", "s"])

    sums = vectors.select(column).mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return max(abs(r["s"] / model.n - (r["i"] == r["j"])) for r in sums.collect())


ROWS_DDL = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """A row per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, {ROWS_DDL}"
    model = fit(vectors, column, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], ddl)
    error = identity_error(vectors, column, model)
    width, k = model.vectors.shape
    shares = model.values / model.trace
    whole, _ = model.centre
    rest = np.array([int(s) - model.n * int(w) for s, w in zip(model.sums, whole)], dtype=object)

    def deviations(x: np.ndarray) -> pa.Array:
        away = x - whole
        most = model.n * int(np.abs(away).max() + 1)
        if width * most * most < 2**63:
            return pa.array(((model.n * away - rest.astype(np.int64)) ** 2).sum(axis=1), pa.int64()).cast(WIDE)
        return pa.array([int(d) for d in ((model.n * away.astype(object) - rest) ** 2).sum(axis=1)], WIDE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in usable(batch, column, width):
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, model.n, dtype=np.int64)),
                        deviations(x).take(each),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(shares, len(at))),
                        pa.array(np.full(len(at) * k, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(key, column).mapInArrow(rows, ddl)
