"""Band power and spectra of windows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from wavetally.operators.blocks import Stage, WindowStage, apply_windows, zero_nan
from wavetally.operators.windows import check_window, relay_windows

# Default bands in Hz, fixed values.
BANDS = {"alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def band_bins(bands: dict[str, tuple[float, float]], W: int, fs: float) -> dict[str, range]:
    """Frequency bins of every band, both ends included."""
    bins = {}
    for name, (low, high) in bands.items():
        if not 0 <= low < high or high > fs / 2:
            raise ValueError(f"band {name} must satisfy 0 <= low < high <= fs/2")
        first, last = (math.floor(f * W / fs + 0.5) for f in (low, high))
        if first >= last or last > W // 2:
            raise ValueError(f"band {name} covers no valid bins for W={W}")
        bins[name] = range(first, last + 1)
    return bins


def bandpower_stage(W: int, fs: float, bands: dict[str, tuple[float, float]] | None = None) -> WindowStage:
    bins = band_bins(bands or BANDS, W, fs)
    used = sorted({k for ks in bins.values() for k in ks})
    angle = 2 * np.pi * np.outer(used, np.arange(W)) / W
    cos, sin = np.cos(angle), np.sin(angle)
    pick = np.array([[1.0 if k in ks else 0.0 for k in used] for ks in bins.values()])

    def block(w: np.ndarray) -> np.ndarray:
        w = zero_nan(w)
        power = (cos @ w) ** 2 + (sin @ w) ** 2
        return pick @ power

    return WindowStage("goertzel", block, tuple(bins))


def fft_stage(W: int, fs: float, nan_to_zero: bool = False) -> WindowStage:
    rest = W
    for p in (2, 3, 5):
        while rest % p == 0:
            rest //= p
    if W < 2 or rest != 1:
        raise ValueError("window length must factor into 2, 3 and 5")

    def block(w: np.ndarray) -> np.ndarray:
        z = np.fft.rfft(zero_nan(w) if nan_to_zero else w, axis=1)
        return z.real**2 + z.imag**2

    return WindowStage("fft", block, hz_per_row=fs / W)


def welch_stage(W: int, fs: float, n_fft: int = 256, n_overlap: int = 128) -> WindowStage:
    """Mean of Hann-windowed periodograms; segments are min(W, n_fft) long and
    padded with zeros to n_fft."""
    if n_fft <= 0 or n_fft & (n_fft - 1) or not 0 <= n_overlap < n_fft:
        raise ValueError("n_fft must be a power of two and 0 <= n_overlap < n_fft")
    seg = min(W, n_fft)
    step = seg - n_overlap
    if step <= 0:
        raise ValueError("overlap must be shorter than the segment")
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    weight = np.full(n_fft // 2 + 1, 2.0 / (fs * np.sum(hann**2)))
    weight[[0, -1]] /= 2

    def block(w: np.ndarray) -> np.ndarray:
        w = zero_nan(w)
        starts = range(0, W - seg + 1, step)
        total = 0.0
        for s in starts:
            z = np.fft.rfft(w[:, s : s + seg] * hann[None, :, None], n=n_fft, axis=1)
            total = total + z.real**2 + z.imag**2
        return total / len(starts) * weight[None, :, None]

    return WindowStage("welch_psd", block, hz_per_row=fs / n_fft)


def goertzel_bandpower(
    signal: DataFrame, W: int = 160, H: int = 80, fs: float = 160.0, bands=None, stages: list[Stage] = ()
) -> DataFrame:
    """Power per band and channel of every full window (unnormalised)."""
    check_window(W, H)
    return apply_windows(signal, bandpower_stage(W, fs, bands), W, H, list(stages))


def fft_magsq(
    signal: DataFrame, W: int = 160, H: int = 80, fs: float = 160.0, nan_to_zero: bool = False, stages: list[Stage] = ()
) -> DataFrame:
    """One-sided squared magnitude spectrum of every full window."""
    check_window(W, H)
    return apply_windows(signal, fft_stage(W, fs, nan_to_zero), W, H, list(stages))


def welch_psd(
    signal: DataFrame,
    W: int = 160,
    H: int = 80,
    fs: float = 160.0,
    n_fft: int = 256,
    n_overlap: int = 128,
    stages: list[Stage] = (),
) -> DataFrame:
    """Power spectral density of every full window."""
    check_window(W, H)
    return apply_windows(signal, welch_stage(W, fs, n_fft, n_overlap), W, H, list(stages))


def on_windows(windowed: DataFrame, final: WindowStage, W: int) -> DataFrame:
    """A window stage over rows that are windows already."""
    return apply_windows(relay_windows(windowed, W), final, W, W)
