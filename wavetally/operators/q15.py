"""Fixed-point (Q15) variants of the kernels; ``x`` is an array of SMALLINT."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.functions.fixedpoint import Q15_HALF, Q15_MAX, Q15_MIN, Q15_SCALE, q15_sat_sub, quantize_q15
from wavetally.operators.blocks import SLICE, Stage, WindowStage, apply_stages, apply_windows
from wavetally.operators.filters import causal_fir, fir_taps, notch_coefficients
from wavetally.operators.q15_notch import Q14_BITS, Q14_HALF, WARM, run_notch
from wavetally.operators.spatial import model_matrix
from wavetally.operators.spectral import BANDS, band_bins
from wavetally.operators.windows import check_window

# Coefficients of recursions are Q14 so that values up to 2 fit; fixed values.
Q14_SCALE = 16384


def quantize_signal(signal: DataFrame, scale: float = 1.0) -> DataFrame:
    return signal.withColumn("x", F.transform("x", lambda v: quantize_q15(v, scale)))


def as_q15(v) -> np.ndarray:
    """Coefficients to Q15 integers (held in doubles, exact)."""
    scaled = np.asarray(v, dtype=float) * Q15_SCALE
    return np.clip(np.trunc(scaled + np.copysign(0.5, scaled)), Q15_MIN, Q15_MAX)


def as_q14(v: float) -> int:
    return int(max(Q15_MIN, min(Q15_MAX, math.trunc(v * Q14_SCALE + math.copysign(0.5, v)))))


def _to_q15(acc: np.ndarray) -> np.ndarray:
    """Sums of Q15 products (below 2^53, so exact in doubles) back to Q15."""
    return np.clip(np.floor((acc + Q15_HALF) / Q15_SCALE), Q15_MIN, Q15_MAX)


def _smallint(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.col("x").cast("array<smallint>"))


def _doubles(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.col("x").cast("array<double>"))


def noop_q15(signal: DataFrame) -> DataFrame:
    return signal.select("*")


def car_q15(signal: DataFrame) -> DataFrame:
    """Subtract the integer channel mean (truncated to 0) with saturation."""
    x = F.col("x")
    total = F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    mean = (F.signum(total) * F.floor(F.abs(total) / F.size(x))).cast("long")
    out = F.transform(F.array(mean), lambda m: F.transform(x, lambda v: q15_sat_sub(v, m)))
    return signal.withColumn("x", out[0])


def fir_q15_stage(fs: float = 160.0, low: float = 8.0, high: float = 30.0, n: int = 129) -> Stage:
    taps = as_q15(fir_taps(fs, low, high, n))
    return Stage("bandpass_fir_q15", n - 1, lambda x: _to_q15(causal_fir(np.nan_to_num(x, nan=0.0), taps)))


def fir_bandpass_q15(signal: DataFrame, fs: float = 160.0, low: float = 8.0, high: float = 30.0) -> DataFrame:
    return _smallint(apply_stages(_doubles(signal), [fir_q15_stage(fs, low, high)]))


def csp_apply_q15(signal: DataFrame, filters: DataFrame) -> DataFrame:
    weights = as_q15(model_matrix(filters, "component", "x")).T.copy()
    return _smallint(apply_stages(_doubles(signal), [Stage("csp_q15", 0, lambda x: _to_q15(x @ weights))]))


def ica_apply_q15(signal: DataFrame, model: DataFrame) -> DataFrame:
    weights = as_q15(model_matrix(model, "row", "weights")).T.copy()
    centre = as_q15(model_matrix(model, "row", "mean")[0])

    def block(x: np.ndarray) -> np.ndarray:
        return _to_q15(np.clip(x - centre, Q15_MIN, Q15_MAX) @ weights)

    return _smallint(apply_stages(_doubles(signal), [Stage("ica_q15", 0, block)]))


def fft_magsq_q15(signal: DataFrame, W: int = 160, H: int = 80, fs: float = 160.0) -> DataFrame:
    """Spectrum of the Q15 samples scaled by 1/W, squared, back to Q15."""
    check_window(W, H)

    def block(w: np.ndarray) -> np.ndarray:
        z = np.fft.rfft(w / Q15_SCALE, axis=1) / W
        power = (z.real**2 + z.imag**2) * Q15_SCALE
        return np.clip(np.floor(power + 0.5), 0, Q15_MAX)

    return _smallint(apply_windows(_doubles(signal), WindowStage("fft_q15", block, hz_per_row=fs / W), W, H))


def goertzel_q15(signal: DataFrame, W: int = 160, H: int = 80, fs: float = 160.0, bands=None) -> DataFrame:
    """Band power by the saturating integer recurrence, one step per sample.

    Saturation makes the recurrence non-linear, so samples of a window are taken
    in order; windows, bins and channels advance side by side.
    """
    check_window(W, H)
    bins = band_bins(bands or BANDS, W, fs)
    used = sorted({k for ks in bins.values() for k in ks})
    coeff = np.array([as_q14(2 * math.cos(2 * math.pi * k / W)) for k in used], dtype=np.int64)[None, :, None]
    pick = [[j for j, k in enumerate(used) if k in ks] for ks in bins.values()]

    def block(w: np.ndarray) -> np.ndarray:
        x = w.astype(np.int64)
        s1 = np.zeros((x.shape[0], len(used), x.shape[2]), dtype=np.int64)
        s2 = np.zeros_like(s1)
        for n in range(x.shape[1]):
            s0 = x[:, n, None, :] + ((coeff * s1 + Q14_HALF) >> Q14_BITS) - s2
            s2, s1 = s1, np.clip(s0, Q15_MIN, Q15_MAX)
        power = s1 * s1 + s2 * s2 - ((coeff * s1 * s2 + Q14_HALF) >> Q14_BITS)
        summed = np.stack([power[:, p].sum(axis=1) for p in pick], axis=1)
        mean = np.sign(summed) * (np.abs(summed) // W)
        return np.clip((mean + Q15_HALF) >> 15, Q15_MIN, Q15_MAX).astype(float)

    return _smallint(apply_windows(_doubles(signal), WindowStage("goertzel_q15", block, tuple(bins)), W, H))


# ---------------------------------------------------------------------- notch


def notch_iir_q15(
    signal: DataFrame, f0: float = 60.0, q: float = 30.0, fs: float = 160.0, length: int = SLICE, warm: int = WARM
) -> DataFrame:
    """Integer notch filter, bit-exact over recordings of any length (see ``q15_notch``)."""
    b, a = notch_coefficients(f0, q, fs, "compat")
    coeffs = [as_q14(v) for v in (*b, *a)]
    return run_notch(_doubles(signal.select("recording_id", "t", "x")), coeffs, length, warm)[0]
