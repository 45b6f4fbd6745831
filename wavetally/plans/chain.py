"""Chains of kernels over a recording, planned as one pass.

Leading per-sample kernels (common average, FIR, notch, spatial filters)
commute with windowing, so they run on the unwindowed slice and the windows are
cut afterwards: overlapping samples are filtered once, and the whole chain
needs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.operators import filters, spatial, spectral
from wavetally.operators.blocks import SLICE, Chain, Stage, WindowStage, apply_chains, apply_windows
from wavetally.operators.windows import check_window

# None stands for any size.
Shape = tuple[int | None, int | None]


@dataclass(frozen=True)
class Kernel:
    """A kernel: per sample (``stage``) or per window (``window``)."""

    name: str
    stage: Stage | None = None
    window: Callable[[int, float], WindowStage] | None = None
    input_shape: Shape = (None, None)
    output_shape: Callable[[int, int], tuple[int, int]] = lambda W, C: (W, C)


def _band_rows(bands):
    return lambda W, C: (len(bands or spectral.BANDS), C)


def noop_kernel() -> Kernel:
    return Kernel("noop", Stage("noop", 0, lambda x: x))


def car_kernel() -> Kernel:
    return Kernel("car", filters.car_stage())


def fir_kernel(fs: float = 160.0, low: float = 8.0, high: float = 30.0) -> Kernel:
    return Kernel("bandpass_fir", filters.fir_stage(fs, low, high))


def notch_kernel(f0: float = 60.0, q: float = 30.0, fs: float = 160.0, design: str = "exact") -> Kernel:
    return Kernel("notch_iir", filters.notch_stage(f0, q, fs, design))


def csp_kernel(model: DataFrame) -> Kernel:
    w = spatial.model_matrix(model, "component", "x")
    return Kernel("csp", spatial.csp_stage(w), None, (None, w.shape[1]), lambda W, C: (W, len(w)))


def ica_kernel(model: DataFrame) -> Kernel:
    w = spatial.model_matrix(model, "row", "weights")
    mean = spatial.model_matrix(model, "row", "mean")[0]
    return Kernel("ica", spatial.ica_stage(w, mean), None, (None, w.shape[1]), lambda W, C: (W, len(w)))


def goertzel_kernel(bands=None) -> Kernel:
    return Kernel("goertzel", None, lambda W, fs: spectral.bandpower_stage(W, fs, bands), output_shape=_band_rows(bands))


def fft_kernel() -> Kernel:
    return Kernel("fft", None, lambda W, fs: spectral.fft_stage(W, fs), output_shape=lambda W, C: (W // 2 + 1, C))


def welch_kernel(n_fft: int = 256, n_overlap: int = 128) -> Kernel:
    return Kernel(
        "welch_psd", None, lambda W, fs: spectral.welch_stage(W, fs, n_fft, n_overlap),
        output_shape=lambda W, C: (n_fft // 2 + 1, C),
    )


BUILT_IN = {
    "noop": noop_kernel, "car": car_kernel, "bandpass_fir": fir_kernel, "notch_iir": notch_kernel, "csp": csp_kernel,
    "ica": ica_kernel, "goertzel": goertzel_kernel, "fft": fft_kernel, "welch_psd": welch_kernel,
}

_REGISTERED: dict[str, Kernel] = {}


def register_kernel(
    name: str,
    fn: Callable[[np.ndarray], np.ndarray],
    output_shape: Callable[[int, int], tuple[int, int]] = lambda W, C: (W, C),
    input_shape: Shape = (None, None),
) -> Kernel:
    """Make a Python function on one (W, C) window usable as a kernel. Names of built-in kernels are taken."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is a built-in kernel")

    def window(W: int, fs: float) -> WindowStage:
        return WindowStage(name, lambda w: np.stack([np.asarray(fn(one), dtype=float) for one in w]))

    _REGISTERED[name] = Kernel(name, None, window, input_shape, output_shape)
    return _REGISTERED[name]


def kernel(name: str, **params) -> Kernel:
    """A kernel by name, built in or registered."""
    if name in _REGISTERED:
        return _REGISTERED[name]
    if name not in BUILT_IN:
        raise ValueError(f"unknown kernel: {name}")
    return BUILT_IN[name](**params)


def chain_shape_check(kernels: list[Kernel], W: int, C: int) -> tuple[int, int]:
    """Output shape of the chain; a kernel that cannot take its input raises."""
    if not kernels:
        raise ValueError("chain has no kernels")
    before = "input"
    for k in kernels:
        for have, want, axis in zip((W, C), k.input_shape, "WC"):
            if want is not None and have != want:
                raise ValueError(f"{before} output {axis}={have} does not fit {k.name} input {axis}={want}")
        W, C = k.output_shape(W, C)
        before = k.name
    return W, C


def shape_mismatches(stages: DataFrame) -> DataFrame:
    """The same check over a table of chain definitions.

    Input: chain_id, position, in_w, in_c, out_w, out_c (null fits anything).
    Returns the stages that cannot follow the one before, with the reason. A
    chain has a handful of stages, so its window is small.
    """
    w = Window.partitionBy("chain_id").orderBy("position")
    seen = stages.select("*", F.lag("out_w").over(w).alias("have_w"), F.lag("out_c").over(w).alias("have_c"))
    reason = F.when(F.col("have_w") != F.col("in_w"), "W").when(F.col("have_c") != F.col("in_c"), "C")
    return seen.withColumn("mismatch", reason).where("mismatch is not null")


def _row_wise(stage: Stage) -> Callable[[np.ndarray], np.ndarray]:
    return lambda w: stage.block(w.reshape(-1, w.shape[2])).reshape(w.shape[0], w.shape[1], -1)


def compiled(name: str, kernels: list[Kernel], W: int, fs: float, channels: int) -> Chain:
    """What a chain does to samples and then to windows; an impossible one raises."""
    chain_shape_check(kernels, W, channels)
    split = next((n for n, k in enumerate(kernels) if k.stage is None), len(kernels))
    leading, rest = kernels[:split], kernels[split:]
    blocks, bands, hz = [], (), None
    rows, cols = W, channels
    for k in leading:
        rows, cols = k.output_shape(rows, cols)
    for k in rest:
        if k.stage is not None:
            if k.stage.history:
                raise ValueError(f"{k.name} keeps history over samples and cannot follow {rest[0].name}")
            blocks.append((k.name, _row_wise(k.stage)))
        else:
            made = k.window(rows, fs)
            blocks.append((k.name, made.block))
            bands, hz = made.bands, made.hz_per_row
        rows, cols = k.output_shape(rows, cols)
    return Chain(name, tuple(k.stage for k in leading), tuple(blocks), tuple(bands), hz)


def kernel_chain(
    signal: DataFrame, kernels: list[Kernel], W: int = 160, H: int = 80, fs: float = 160.0, channels: int = 64,
    length: int = SLICE,
) -> DataFrame:
    """Windows of the chain's output: recording_id, window_index, i, x."""
    check_window(W, H)
    made = compiled("chain", kernels, W, fs, channels)
    final = WindowStage("chain", lambda w: reduce(lambda v, b: b[1](v), made.blocks, w), made.bands, made.hz_per_row)
    return apply_windows(signal, final, W, H, list(made.stages), length)


def kernel_chains(
    signal: DataFrame, chains: list[tuple[str, list[Kernel]]], W: int = 160, H: int = 80, fs: float = 160.0,
    channels: int = 64, length: int = SLICE,
) -> tuple[DataFrame | None, DataFrame]:
    """Several named chains over one signal, read and cut once: (windows of all chains, one status row per chain).

    Equal names are numbered, empty chains skipped, impossible ones reported. A chain that fails while it runs has rows with
    ``window_failed`` = 1 and the failed kernel where it did, and leaves the others whole."""
    check_window(W, H)
    made, status, used = [], [], {}
    for name, kernels in chains:
        safe = name.translate(str.maketrans("/ ", "__"))
        used[safe] = used.get(safe, 0) + 1
        label = safe if used[safe] == 1 else f"{safe}-{used[safe]}"
        text = " -> ".join(k.name for k in kernels)
        if not kernels:
            status.append((label, text, "skipped: no kernels"))
            continue
        try:
            made.append(compiled(label, kernels, W, fs, channels))
        except ValueError as e:
            status.append((label, text, f"failed: {e}"))
            continue
        status.append((label, text, "ok"))
    table = signal.sparkSession.createDataFrame(status, "chain string, kernels string, status string")
    return apply_chains(signal, made, W, H, length) if made else None, table


def kernel_chain_multi(
    signal: DataFrame, chains: list[tuple[str, list[Kernel]]], W: int = 160, H: int = 80, fs: float = 160.0,
    channels: int = 64,
) -> tuple[DataFrame | None, DataFrame]:
    """``kernel_chains`` without the windows that failed, and without columns that no chain fills."""
    whole, table = kernel_chains(signal, chains, W, H, fs, channels)
    if whole is None:
        return None, table
    kernels = [k for _, ks in chains for k in ks]
    empty = [] if any(k.name == "goertzel" for k in kernels) else ["band"]
    empty += [] if any(k.name in ("fft", "welch_psd") for k in kernels) else ["freq_hz"]
    return whole.where("window_failed = 0").drop("window_failed", "failed_kernel", "error", *empty), table
