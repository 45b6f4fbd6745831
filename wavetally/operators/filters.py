"""Filters that map a signal to a signal: identity, common average, FIR, notch."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.blocks import SIGNAL_DDL, SLICE, Stage, apply_stages, dense, sliced, to_lists, zero_nan
from wavetally.operators.windows import relay_windows
from wavetally.session import materialize

# A decayed filter state below this share is less than half a unit in the last
# place of a double.
NEGLIGIBLE = 1e-18

# Default notch (60 Hz, Q 30, 160 Hz): these triples use the exact design also
# under ``design='compat'``; fixed values.
EXACT_NOTCH = (60.0, 30.0, 160.0)


def noop(signal: DataFrame) -> DataFrame:
    return signal.select("*")


# ------------------------------------------------------------- common average


def _car_block(x: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(x)
    n = ok.sum(axis=1, keepdims=True)
    mean = np.where(ok, x, 0.0).sum(axis=1, keepdims=True) / np.maximum(n, 1)
    return np.where(ok, x - mean, 0.0)


def car_stage() -> Stage:
    return Stage("car", 0, _car_block)


def car(signal: DataFrame) -> DataFrame:
    """Subtract the mean over the valid channels from every sample; a NaN
    sample becomes 0. Runs where the rows lie; on arrays this is faster than
    Spark's array functions, which are interpreted element by element."""
    return apply_stages(signal, [car_stage()])


# ------------------------------------------------------------------------ FIR


def fir_taps(fs: float = 160.0, low: float = 8.0, high: float = 30.0, n: int = 129) -> np.ndarray:
    """Band-pass taps: windowed sinc (Hamming), unit gain at the band centre."""
    if not 0 < low < high < fs / 2:
        raise ValueError("band must satisfy 0 < low < high < fs/2")
    m = np.arange(n) - (n - 1) / 2
    lo, hi = 2 * low / fs, 2 * high / fs
    ideal = hi * np.sinc(hi * m) - lo * np.sinc(lo * m)
    shaped = ideal * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return shaped / np.sum(shaped * np.cos(np.pi * m * (lo + hi) / 2))


def causal_fir(x: np.ndarray, taps: np.ndarray, rows: int = 128) -> np.ndarray:
    """y[t] = sum_k taps[k] x[t-k] with silence before, as banded products."""
    back = len(taps) - 1
    if not np.isfinite(x).all():
        return _plain_fir(x, taps)
    lag = back + np.arange(rows)[:, None] - np.arange(rows + back)[None, :]
    band = np.where((lag >= 0) & (lag <= back), taps[np.clip(lag, 0, back)], 0.0)
    n = -(-len(x) // rows) * rows
    padded = np.zeros((n + back, x.shape[1]))
    padded[back : back + len(x)] = x
    parts = [band @ padded[s : s + rows + back] for s in range(0, n, rows)]
    return np.concatenate(parts)[: len(x)] if parts else x


def _plain_fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Tap by tap, so that an infinite sample meets the outputs it belongs to and no others."""
    y = np.zeros_like(x)
    with np.errstate(invalid="ignore"):
        for k, tap in enumerate(taps[: len(x)]):
            y[k:] += tap * x[: len(x) - k]
    return y


def fir_stage(fs: float = 160.0, low: float = 8.0, high: float = 30.0, n: int = 129) -> Stage:
    taps = fir_taps(fs, low, high, n)
    return Stage("bandpass_fir", n - 1, lambda x: causal_fir(zero_nan(x), taps))


def fir_bandpass(signal: DataFrame, fs: float = 160.0, low: float = 8.0, high: float = 30.0, n: int = 129) -> DataFrame:
    """Causal band-pass over the whole recording; NaN counts as 0. Filtering
    before windowing equals filtering with history kept between windows."""
    return apply_stages(signal, [fir_stage(fs, low, high, n)])


# ---------------------------------------------------------------------- notch


def notch_coefficients(f0: float = 60.0, q: float = 30.0, fs: float = 160.0, design: str = "exact"):
    """(b0, b1, b2), (a1, a2) of the second-order notch."""
    if f0 <= 0 or q <= 0 or f0 >= fs / 2:
        raise ValueError("notch needs 0 < f0 < fs/2 and Q > 0")
    w = 2 * math.pi * f0 / fs
    c = math.cos(w)
    if design == "compat" and any(abs(a - b) >= 1e-6 for a, b in zip((f0, q, fs), EXACT_NOTCH)):
        radius = math.exp(-math.pi * f0 / q / fs)
        return (1.0, -2 * c, 1.0), (-2 * radius * c, radius * radius)
    gain = 1 / (1 + math.tan(w / q / 2))
    return (gain, -2 * gain * c, gain), (-2 * gain * c, 2 * gain - 1)


def decay_length(a2: float) -> int:
    """Samples until the state of the recursion has died out."""
    radius = math.sqrt(abs(a2))
    return 2 + math.ceil(math.log(NEGLIGIBLE) / math.log(radius)) if radius > 0 else 2


def recursion(x: np.ndarray, b, a, state: np.ndarray | None = None, rows: int = 128) -> np.ndarray:
    """Second-order recursion in blocks: inside a block the response is one
    triangular product, between blocks only the last two outputs are handed on.

    ``state`` holds x[-1], x[-2], y[-1], y[-2] per channel.
    """
    b0, b1, b2 = b
    a1, a2 = a
    s = np.zeros((4, x.shape[1])) if state is None else state
    past = np.concatenate([s[1:2], s[0:1], x])
    with np.errstate(invalid="ignore"):
        drive = b0 * past[2:] + b1 * past[1:-1] + b2 * past[:-2]
    if not (np.isfinite(drive).all() and np.isfinite(s).all()):
        return _plain_recursion(drive, a1, a2, s)
    pulse = np.zeros(rows + 1)
    pulse[0] = 1.0
    pulse[1] = -a1
    for k in range(2, rows + 1):
        pulse[k] = -a1 * pulse[k - 1] - a2 * pulse[k - 2]
    lag = np.arange(rows)[:, None] - np.arange(rows)[None, :]
    tri = np.where(lag >= 0, pulse[np.clip(lag, 0, rows)], 0.0)
    y = np.empty_like(drive)
    y1, y2 = s[2], s[3]
    for at in range(0, len(x), rows):
        part = drive[at : at + rows]
        n = len(part)
        out = tri[:n, :n] @ part + np.outer(pulse[1 : n + 1], y1) - a2 * np.outer(pulse[:n], y2)
        y[at : at + n] = out
        y1, y2 = out[-1], (out[-2] if n > 1 else y1)
    return y


def _plain_recursion(drive: np.ndarray, a1: float, a2: float, s: np.ndarray) -> np.ndarray:
    """Sample by sample, for slices with infinite samples."""
    y = np.empty_like(drive)
    y1, y2 = s[2], s[3]
    with np.errstate(invalid="ignore"):
        for t in range(len(drive)):
            y[t] = drive[t] - a1 * y1 - a2 * y2
            y1, y2 = y[t], y1
    return y


def notch_stage(f0: float = 60.0, q: float = 30.0, fs: float = 160.0, design: str = "exact") -> Stage:
    b, a = notch_coefficients(f0, q, fs, design)
    return Stage("notch_iir", decay_length(a[1]), lambda x: recursion(zero_nan(x), b, a))


def notch_iir(
    signal: DataFrame,
    f0: float = 60.0,
    q: float = 30.0,
    fs: float = 160.0,
    mode: str = "continuous",
    design: str = "exact",
    W: int | None = None,
    length: int = SLICE,
) -> DataFrame:
    """Notch filter; NaN counts as 0.

    ``continuous`` filters the recording. ``window_replay`` takes windowed rows
    (recording_id, window_index, i, x) and carries the state from the end of a
    window into the next one, overlap included.
    """
    if mode == "window_replay":
        if W is None:
            raise ValueError("window_replay needs the window length")
        out = notch_iir(relay_windows(signal, W), f0, q, fs, "continuous", design, None, length)
        return out.select(
            "recording_id", F.floor(F.col("t") / W).alias("window_index"), (F.col("t") % W).cast("int").alias("i"), "x"
        )
    if mode != "continuous":
        raise ValueError(f"unknown notch mode: {mode}")
    stage = notch_stage(f0, q, fs, design)
    if stage.history <= length:
        return apply_stages(signal, [stage], length)
    b, a = notch_coefficients(f0, q, fs, design)
    return _notch_by_scan(signal, b, a, length)


def _notch_by_scan(signal: DataFrame, b, a, length: int) -> DataFrame:
    """For states that outlast a slice: filter every slice from silence, hand
    the end states on by a doubling scan over slices, filter again from them."""
    a1, a2 = a
    signal = signal if isinstance(signal, DataFrame) else signal.samples()

    def ends(key: tuple, table: pa.Table) -> pa.Table:
        first, x, _ = dense(table)
        here = key[1].as_py() * length
        x = zero_nan(x)
        past = np.zeros((2, x.shape[1]))
        lead = here - first
        if lead > 0:
            past[2 - min(2, lead) :] = x[lead - min(2, lead) : lead]
        x = x[lead:]
        if len(x) == 0:
            return pa.table({"recording_id": pa.array([], pa.string()), "slice": pa.array([], pa.int64()),
                             "s": pa.array([], pa.list_(pa.float64()))})
        state = np.stack([past[1], past[0], np.zeros(x.shape[1]), np.zeros(x.shape[1])])
        y = recursion(x, b, a, state)
        last = np.concatenate([y[-1], y[-2] if len(y) > 1 else np.zeros(x.shape[1])])
        return pa.table({"recording_id": [key[0].as_py()], "slice": [key[1].as_py()], "s": to_lists(last[None, :])})

    parts = sliced(signal.select("recording_id", "t", "x"), length, before=2)
    states = parts.groupBy("recording_id", "slice").applyInArrow(ends, "recording_id string, slice long, s array<double>")
    states = materialize(states, "notch-states")
    step = np.linalg.matrix_power(np.array([[-a1, -a2], [1.0, 0.0]]), length)
    reach = 1
    slices = states.agg(F.max("slice")).first()[0] or 0
    while reach <= slices and np.abs(step).max() >= NEGLIGIBLE:
        m = [[float(v) for v in row] for row in step]
        earlier = states.select("recording_id", (F.col("slice") + reach).alias("slice"), F.col("s").alias("_e"))
        half = (F.size("_e") / 2).cast("int")
        y1, y2 = F.slice("_e", F.lit(1), half), F.slice("_e", half + 1, half)
        carried = F.concat(
            F.zip_with(y1, y2, lambda p, q: p * m[0][0] + q * m[0][1]),
            F.zip_with(y1, y2, lambda p, q: p * m[1][0] + q * m[1][1]),
        )
        states = materialize(
            states.join(earlier, ["recording_id", "slice"], "left").select(
                "recording_id",
                "slice",
                F.when(F.col("_e").isNull(), F.col("s")).otherwise(F.zip_with("s", carried, lambda p, q: p + q)).alias("s"),
            ),
            "notch-states",
        )
        step = step @ step
        reach *= 2

    def run(key: tuple, rows: pa.Table, carried: pa.Table) -> pa.Table:
        here = key[1].as_py() * length
        if rows.num_rows == 0:
            return pa.table({"recording_id": pa.array([], pa.string()), "t": pa.array([], pa.int64()),
                             "x": pa.array([], pa.list_(pa.float64()))})
        first, x, seen = dense(rows)
        x = zero_nan(x)
        c = x.shape[1]
        lead = max(0, here - first)
        past = np.zeros((2, c))
        if lead > 0:
            past[2 - min(2, lead) :] = x[lead - min(2, lead) : lead]
        s = np.asarray(carried.column("s")[0].as_py()) if carried.num_rows else np.zeros(2 * c)
        y = recursion(x[lead:], b, a, np.stack([past[1], past[0], s[:c], s[c:]])) if len(x) > lead else x[:0]
        keep = np.flatnonzero(seen[lead:])
        return pa.table(
            {
                "recording_id": pa.array([key[0].as_py()] * len(keep), pa.string()),
                "t": pa.array(keep + first + lead, pa.int64()),
                "x": to_lists(y[keep]),
            }
        )

    before = states.select("recording_id", (F.col("slice") + 1).alias("slice"), "s")
    keys = ["recording_id", "slice"]
    return parts.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInArrow(run, SIGNAL_DDL)
