"""Training over many windows: covariances, whitening, CSP, FastICA.

Passes over the samples return sums whose size depends on the channel count
only; the driver decomposes these channel x channel matrices.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.operators.blocks import Stage, apply_stages, by_width, zero_nan
from wavetally.operators.ordered import broadcast_if_small

EIGEN_FLOOR = 1e-10

# Diagonal terms that keep class covariances and their sum invertible.
CSP_RIDGE = 1e-6
CSP_WHITEN_RIDGE = 1e-8


def channel_sums(signal: DataFrame) -> DataFrame:
    """Per channel: number and sum of the valid samples (summed per task first)."""

    def partial(batches):
        sums: dict[int, tuple] = {}
        for batch in batches:
            for _, x in by_width(batch):
                ok = ~np.isnan(x)
                s, n = np.where(ok, x, 0.0).sum(axis=0), ok.sum(axis=0)
                total, count = sums.get(x.shape[1], (0.0, 0))
                sums[x.shape[1]] = (total + s, count + n)
        for width, (total, count) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(width, dtype=np.int32)),
                    pa.array(count.astype(np.int64)),
                    pa.array(total),
                    pa.array(np.full(width, width, dtype=np.int32)),
                ],
                ["ch", "n", "s", "width"],
            )

    parts = signal.select("x").mapInArrow(partial, "ch int, n long, s double, width int")
    return parts.groupBy("ch").agg(F.sum("n").alias("n"), one_width(F.sum("s")).alias("s"))


def one_width(value):
    """A sum over tasks, or an error: one model cannot be trained on signals of different channel counts."""
    mixed = F.raise_error(F.lit("training needs recordings of one channel count")).cast("double")
    return F.when(F.min("width") == F.max("width"), value).otherwise(mixed)


def channel_means(signal: DataFrame) -> DataFrame:
    """Mean of the valid samples of every channel, 0 if there are none."""
    return channel_sums(signal).select("ch", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("mean"))


def _vector(means: DataFrame) -> np.ndarray:
    return np.array([r["mean"] for r in sorted(means.collect(), key=lambda r: r["ch"])])


# Matrices leave a task in blocks of rows of about this size.
BLOCK_BYTES = 1 << 18
# Partial sums of so many groups of tasks are added up first.
FAN = 32
# Bytes of partial sums of one ICA pass that may come to the driver as they are.
SMALL_SUMS = 16 << 20

SUMS_DDL = "label int, block int, task int, n long, width int, data binary"
_SUMS = ["label", "block", "task", "n", "width", "data"]


def _sum_rows(sums: dict[tuple[int, int], tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (label, block), (task, n, width, values) in sums.items():
        cells = [[label], [block], [task], [n], [width], [np.ascontiguousarray(values).tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], _SUMS)


def summed(parts: DataFrame, tasks: int = FAN + 1) -> DataFrame:
    """Sums of the blocks that tasks return, per label and block.

    Beyond ``FAN`` tasks a tree of two levels: tasks by groups, then the groups. Blocks are added as they stream by, in the
    order of tasks, so a reducer holds one block at a time and the result does not change from run to run."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                label, block, task, n, width = (batch.column(j)[i].as_py() for j in range(5))
                values = np.frombuffer(batch.column(5)[i].as_buffer())
                if (label, block) == key:
                    if held[2] != width:
                        raise ValueError("training needs recordings of one channel count")
                    held = (held[0], held[1] + n, width, held[3] + values)
                    continue
                if held is not None:
                    yield from _sum_rows({key: held})
                key, held = (label, block), (task, n, width, values)
        if held is not None:
            yield from _sum_rows({key: held})

    found = parts.withColumn("task", F.spark_partition_id())
    if tasks > FAN:
        group = F.col("task") % FAN
        found = found.repartition("label", "block", group).sortWithinPartitions("label", "block", group, "task").mapInArrow(add, SUMS_DDL)
    return found.repartition("label", "block").sortWithinPartitions("label", "block", "task").mapInArrow(add, SUMS_DDL)


def _row_blocks(size: int) -> list[tuple[int, int]]:
    rows = max(1, BLOCK_BYTES // (8 * size))
    return [(at, min(size, at + rows)) for at in range(0, size, rows)]


def gram(signal: DataFrame, centre: np.ndarray | None = None, label: str | None = None) -> DataFrame:
    """Sums of x_i x_j per label over all samples, NaN as 0 after centring, with the number of samples.

    A task returns the upper triangle in blocks of rows, at most 8 C^2 bytes and one block; see ``summed``."""

    def partial(batches):
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in by_width(batch):
                x = zero_nan(x if centre is None else x - centre)
                marks = rows.column("label").to_numpy(zero_copy_only=False)
                for m in np.unique(marks).tolist():
                    part = x[marks == m]
                    n, g = sums.get(m, (0, 0.0))
                    if n and len(g) != x.shape[1]:
                        raise ValueError("training needs recordings of one channel count")
                    sums[m] = (n + len(part), g + part.T @ part)
        for m, (n, g) in sums.items():
            for b, (lo, hi) in enumerate(_row_blocks(len(g))):
                yield from _sum_rows({(m, b): (0, n, len(g), g[lo:hi, lo:])})

    mark = F.lit(0) if label is None else F.col(label)
    return summed(signal.select("x", mark.cast("int").alias("label")).mapInArrow(partial, SUMS_DDL))


def covariance(signal: DataFrame, centred: bool = True, label: str | None = None) -> DataFrame:
    """Rows (label, i, j, cov), i <= j: centred or raw second moments / n."""
    centre = _vector(channel_means(signal)) if centred else None

    def rows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                label, block, _, n, width = (batch.column(j)[k].as_py() for j in range(5))
                lo, hi = _row_blocks(width)[block]
                values = np.frombuffer(batch.column(5)[k].as_buffer()).reshape(hi - lo, width - lo)
                i, j = np.triu_indices(hi - lo, m=width - lo)
                cells = [np.full(len(i), label, np.int32), (i + lo).astype(np.int32), (j + lo).astype(np.int32), values[i, j] / n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["label", "i", "j", "cov"])

    return gram(signal, centre, label).mapInArrow(rows, "label int, i int, j int, cov double")


def _matrices(sums: DataFrame) -> dict[int, np.ndarray]:
    """Symmetric matrices of second moments per label; channel x channel values reach the driver, as blocks."""
    out: dict[int, np.ndarray] = {}
    for r in sums.select("label", "block", "n", "width", "data").toArrow().to_pylist():
        full = out.setdefault(r["label"], np.zeros((r["width"], r["width"])))
        lo, hi = _row_blocks(r["width"])[r["block"]]
        values = np.triu(np.frombuffer(r["data"]).reshape(hi - lo, -1)) / r["n"]
        full[lo:hi, lo:] = values
        full[lo:, lo:hi] = np.where(values.T != 0, values.T, full[lo:, lo:hi])
    return out


def whitening_matrix(cov: np.ndarray) -> np.ndarray:
    """K = V D^-1/2 V^T with small eigenvalues floored."""
    d, v = np.linalg.eigh(cov)
    return (v / np.sqrt(np.maximum(d, EIGEN_FLOOR))) @ v.T


def whiten(signal: DataFrame) -> DataFrame:
    """Centred samples times the whitening matrix of the signal."""
    mean = _vector(channel_means(signal))
    k = whitening_matrix(_matrices(gram(signal, mean))[0])
    return apply_stages(signal, [Stage("whiten", 0, lambda x: zero_nan(x - mean) @ k)])


def _signed(filters: np.ndarray) -> np.ndarray:
    """Eigenvectors have no sign: make the largest weight of each positive."""
    top = np.abs(filters).argmax(axis=1)
    return filters * np.sign(filters[np.arange(len(filters)), top])[:, None]


def csp_filters(c0: np.ndarray, c1: np.ndarray, n_components: int) -> np.ndarray:
    """Rows: the m directions with the largest and the m with the smallest
    share of class-1 variance."""
    size = len(c0)
    if n_components % 2 or not 0 < n_components <= size:
        raise ValueError("n_components must be even and at most the channel count")
    c0, c1 = c0 + CSP_RIDGE * np.eye(size), c1 + CSP_RIDGE * np.eye(size)
    d, u = np.linalg.eigh(c0 + c1)
    p = (u / np.sqrt(d + CSP_WHITEN_RIDGE)).T
    share, b = np.linalg.eigh(p @ c1 @ p.T)
    ordered = (b[:, np.argsort(share)[::-1]]).T @ p
    m = n_components // 2
    return _signed(np.concatenate([ordered[:m], ordered[size - m :]]))


def csp_calibrate(signal: DataFrame, labels: DataFrame, W: int, n_components: int = 4) -> DataFrame:
    """Train spatial filters on consecutive windows of W samples.

    ``labels(window_index, label)``, for all recordings alike or with a ``recording_id``, must hold exactly two classes. Windows are
    equally long, so averaging their second moments is one sum per class.
    Returns ``component, x``.
    """
    classes = sorted(r[0] for r in labels.select("label").distinct().limit(3).collect())
    if len(classes) != 2:
        raise ValueError(f"CSP needs exactly two classes, got {classes}")
    # consecutive windows need no copies: a sample's window is t div W; samples missing or past the last full window count as
    # they do in ``non_overlapping_windows``
    whole = signal.groupBy("recording_id", F.floor(F.col("t") / W).alias("window_index")).agg(F.count("*").alias("n")).where(F.col("n") == W)
    keys = [c for c in ("recording_id", "window_index") if c in labels.columns]
    wanted = broadcast_if_small(whole.drop("n").join(labels.select(*keys, "label"), keys))
    rows = signal.select("recording_id", "x", F.floor(F.col("t") / W).alias("window_index"))
    marked = rows.join(wanted, ["recording_id", "window_index"])
    found = _matrices(gram(marked, label="label"))
    filters = csp_filters(found[classes[0]], found[classes[1]], n_components)
    rows = [(i, [float(v) for v in f]) for i, f in enumerate(filters)]
    return signal.sparkSession.createDataFrame(rows, "component int, x array<double>")


def decorrelated(w: np.ndarray) -> np.ndarray:
    """(W W^T)^-1/2 W."""
    u, _, v = np.linalg.svd(w)
    return u @ v


@dataclass(frozen=True)
class Contrast:
    """What one pass over whitened samples z says about an unmixing W: means of tanh(y_i) y_j, of 1 - tanh(y_i)^2 and of
    log cosh(y_i), for y = W z."""

    cross: np.ndarray
    slope: np.ndarray
    value: np.ndarray

    @property
    def excess(self) -> np.ndarray:
        """Above 0 where a component is flatter than a normal variable, below where it is more peaked."""
        return np.diag(self.cross) - self.slope

    def gradient(self, sign: np.ndarray) -> np.ndarray:
        """Of the signed sum of values, along rotations."""
        g = sign[:, None] * self.cross
        return (g - g.T) / 2

    def distance(self) -> float:
        """How far the fixed-point rule would turn a component, as 1 - |cosine|: its sign does not matter."""
        turned = decorrelated(self.cross - np.diag(self.slope))
        return float(np.abs(np.abs(np.diag(turned)) - 1).max())


def _contrast(signal: DataFrame, tasks: int, mean: np.ndarray, k: np.ndarray, w: np.ndarray) -> Contrast:
    """All sums of an iteration in one pass."""
    unmix = (w @ k.T).T  # z = (x - mean) k, y = z w^T

    def partial(batches):
        n, total = 0, 0.0
        for batch in batches:
            for _, x in by_width(batch):
                y = zero_nan(x - mean) @ unmix
                g = np.tanh(y)
                size = np.abs(y)
                log_cosh = size + np.log1p(np.exp(-2 * size)) - np.log(2.0)
                n += len(y)
                total = total + np.concatenate([g.T @ y, (1.0 - g * g).sum(axis=0)[:, None], log_cosh.sum(axis=0)[:, None]], axis=1)
        if n:
            for b, (lo, hi) in enumerate(_row_blocks(len(mean))):
                yield from _sum_rows({(0, b): (0, n, len(mean), total[lo:hi])})

    c = len(mean)
    parts = signal.select("x").mapInArrow(partial, SUMS_DDL)
    if tasks * 8 * c * (c + 2) <= SMALL_SUMS:
        parts = parts.withColumn("task", F.spark_partition_id())  # few enough to be added up here
    else:
        parts = summed(parts, tasks)
    blocks: dict[int, np.ndarray] = {}
    n = 0
    for r in sorted(parts.select("block", "task", "n", "data").toArrow().to_pylist(), key=lambda r: (r["block"], r["task"])):
        values = np.frombuffer(r["data"]).reshape(-1, c + 2)
        blocks[r["block"]] = blocks[r["block"]] + values if r["block"] in blocks else values
        n += r["n"] if r["block"] == 0 else 0
    sums = np.concatenate([blocks[b] for b in sorted(blocks)]) / n
    return Contrast(sums[:, :-2], sums[:, -2], sums[:, -1])


def _rotation(a: np.ndarray) -> np.ndarray:
    """An orthogonal matrix near I + A for a skew A (Cayley)."""
    one = np.eye(len(a))
    return np.linalg.solve(one - a / 2, one + a / 2)


# Memory of the quasi-Newton step, least curvature of a pair of components, longest turn, least share of the foreseen gain.
MEMORY = 10
LEAST_CURVATURE = 1e-2
LONGEST_TURN = 0.5
ARMIJO = 1e-4


def _ascent(gradient: np.ndarray, curvature: np.ndarray, past: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """The two-loop recursion of limited-memory BFGS with the curvature of each pair of components to start from."""
    q, used = gradient.copy(), []
    for turn, change, r in reversed(past):
        used.append(r * (turn * q).sum())
        q -= used[-1] * change
    q /= curvature
    for (turn, change, r), a in zip(past, reversed(used)):
        q += turn * (a - r * (change * q).sum())
    return q


def fastica(signal: DataFrame, max_iter: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Symmetric ICA (tanh) from a fixed start: unmixing matrix, channel means, passes over the samples, and how far the
    fixed-point rule would still turn a component (1 - |cosine|).

    The fixed points of the symmetric rule ``W <- decorrelated(E[g(y) z] - E[g'(y)] W)`` are the rotations at which the sum
    of ``s_i E[log cosh y_i]`` is stationary, where ``s_i`` says whether component ``i`` is flatter or more peaked than a
    normal variable. The plain rule goes round in circles where components are close to normal; here that sum is made larger from
    pass to pass by quasi-Newton turns with a line search, until the rule itself would turn no component by more than ``tol``."""
    rows = signal.select("x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean = _vector(channel_means(rows))
        tasks = rows.rdd.getNumPartitions()
        k = whitening_matrix(_matrices(gram(rows, mean))[0])
        c = len(mean)
        i, j = np.meshgrid(np.arange(c), np.arange(c), indexing="ij")
        w = decorrelated(np.eye(c) + 0.01 * np.sin(37 * i + 17 * j))
        now, passes, past, sign = _contrast(rows, tasks, mean, k, w), 1, [], None
        while now.distance() > tol and passes < max_iter:
            old, sign = sign, np.where(now.excess >= 0, 1.0, -1.0)
            if old is not None and (old != sign).any():
                past = []  # another sum is made larger now
            gradient = now.gradient(sign)
            size = np.abs(now.excess)
            curvature = np.maximum((size[:, None] + size[None, :]) / 2, LEAST_CURVATURE)
            turn = _ascent(gradient, curvature, past)
            gain = (turn * gradient).sum()
            if gain <= 0:
                past, turn = [], gradient / curvature
                gain = (turn * gradient).sum()
            step = min(1.0, LONGEST_TURN / max(np.abs(turn).max(), 1e-300))
            while True:
                tried = _rotation(step * turn) @ w
                found = _contrast(rows, tasks, mean, k, tried)
                passes += 1
                if (sign * (found.value - now.value)).sum() >= ARMIJO * step * gain or step < 1e-3 or passes >= max_iter:
                    break
                step /= 4
            moved, change = step * turn, gradient - found.gradient(sign)
            if (moved * change).sum() > 0:
                past = [*past, (moved, change, 1 / (moved * change).sum())][-MEMORY:]
            w, now = tried, found
        return w @ k, mean, passes, now.distance()
    finally:
        rows.unpersist()


def ica_model(spark: SparkSession, unmixing: np.ndarray, mean: np.ndarray) -> DataFrame:
    centre = [float(v) for v in mean]
    rows = [(i, [float(v) for v in r], centre) for i, r in enumerate(unmixing)]
    return spark.createDataFrame(rows, "row int, weights array<double>, mean array<double>")


def fastica_calibrate(signal: DataFrame, max_iter: int = 200, tol: float = 1e-4) -> DataFrame:
    """Trained model: row, weights, mean."""
    unmixing, mean, passes, distance = fastica(signal, max_iter, tol)
    if distance > tol:
        warnings.warn(f"ICA stopped after {passes} passes at {distance:.1e}, above the tolerance {tol:.1e}", stacklevel=2)
    return ica_model(signal.sparkSession, unmixing, mean)
