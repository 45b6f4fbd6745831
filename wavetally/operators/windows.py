"""Sliding and consecutive windows over a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.operators.ordered import broadcast_if_small


def check_window(W: int, H: int) -> None:
    if W <= 0 or H <= 0 or H > W:
        raise ValueError(f"invalid hop/window: W={W}, H={H}")


def recording_lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy("recording_id").agg((F.max("t") + 1).alias("n_samples"))


def window_numbers(W: int, H: int):
    """Numbers of the windows a sample belongs to, in order."""
    first = F.greatest(F.ceil((F.col("t") - W + 1) / H), F.lit(0).cast("long"))
    return F.sequence(first, F.floor(F.col("t") / H))


def sliding_windows(signal: DataFrame, W: int, H: int) -> DataFrame:
    """Rows (recording_id, window_index, i, x) of every full window.

    Window k covers samples [k*H, k*H+W). A window is full when all its W samples exist, as it is for spectra. Its rows
    lie together after one shuffle by (recording, window), which also serves per-window work that follows.
    """
    check_window(W, H)
    rest = [c for c in signal.columns if c not in ("recording_id", "t")]
    cut = signal.select("recording_id", F.explode(window_numbers(W, H)).alias("window_index"), "t", *rest)
    size = F.count("*").over(Window.partitionBy("recording_id", "window_index"))
    return cut.withColumn("_n", size).where(F.col("_n") == W).select(
        "recording_id", "window_index", (F.col("t") - F.col("window_index") * H).cast("int").alias("i"), *rest
    )


def flush_windows(signal: DataFrame, W: int, H: int, fed: int) -> DataFrame:
    """What the end of input still emits after ``fed`` samples were windowed:
    the remaining full windows, never a partial one."""
    done = max(0, (fed - W) // H + 1) if fed >= W else 0
    return sliding_windows(signal, W, H).where(F.col("window_index") >= done)


def non_overlapping_windows(signal: DataFrame, W: int) -> DataFrame:
    """Consecutive windows of W samples; the remainder is dropped."""
    return sliding_windows(signal, W, W)


def relay_windows(windowed: DataFrame, W: int) -> DataFrame:
    """Windows laid end to end as one recording: t = window_index * W + i."""
    return windowed.select("recording_id", (F.col("window_index") * W + F.col("i")).alias("t"), "x")


def cyclic_replay(signal: DataFrame, H: int, cycles: int) -> DataFrame:
    """The recording repeated; each pass drops the trailing partial hop."""
    if H <= 0 or cycles <= 0:
        raise ValueError("hop and cycles must be > 0")
    sized = signal.join(broadcast_if_small(recording_lengths(signal)), "recording_id")
    whole = F.floor(F.col("n_samples") / H) * H
    rest = [c for c in signal.columns if c not in ("recording_id", "t")]
    return (
        sized.withColumn("_whole", whole)
        .where(F.col("t") < F.col("_whole"))
        .withColumn("_cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cycles - 1).cast("long"))))
        .select("recording_id", (F.col("_cycle") * F.col("_whole") + F.col("t")).alias("t"), *rest)
    )


def long_form(signal: DataFrame) -> DataFrame:
    """One row per (sample, channel)."""
    rest = [c for c in signal.columns if c != "x"]
    return signal.select(*rest, F.posexplode("x").alias("ch", "v"))
