"""Synthetic signals, one recording per row of a table of specifications."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.session import materialize

BLOCK = 65536

PIECE = 128

# Shortest series that has octaves to speak of.
MIN_NOISE_SAMPLES = 16


def _checked(specs: DataFrame, amplitude: str, frequency: str | None = None) -> DataFrame:
    """Reject impossible specifications when they are read."""
    ok = (F.col("fs") > 0) & (F.col("channels") > 0) & (F.col("duration_s") > 0) & (F.col(amplitude) > 0)
    if frequency:
        ok = ok & (F.col(frequency) > 0) & (F.col(frequency) < F.col("fs") / 2)
    n = F.floor(F.col("duration_s") * F.col("fs"))
    bad = F.raise_error(F.concat(F.lit("bad signal specification: "), F.col("recording_id").cast("string"))).cast("long")
    return specs.withColumn("n", F.when(ok, n).otherwise(bad))


def _times(specs: DataFrame) -> DataFrame:
    """One row per sample; blocks of a long recording go to different tasks."""
    last_block = F.floor((F.col("n") - 1) / BLOCK)
    blocks = specs.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    blocks = blocks.repartition("recording_id", "_b")
    first = F.col("_b") * BLOCK
    return blocks.withColumn("t", F.explode(F.sequence(first, F.least(F.col("n"), first + BLOCK) - 1))).drop("_b")


def generate_sine(specs: DataFrame) -> DataFrame:
    """A sin(2 pi f t) on every channel. Input: recording_id, duration_s, fs,
    channels, frequency_hz, amplitude_uv_peak."""
    rows = _times(_checked(specs, "amplitude_uv_peak", "frequency_hz"))
    v = F.col("amplitude_uv_peak") * F.sin(2 * np.pi * F.col("frequency_hz") * (F.col("t") / F.col("fs")))
    return rows.select("recording_id", "t", F.array_repeat(v, F.col("channels").cast("int")).alias("x"))


def _relaxations(n: int) -> np.ndarray:
    """Decay per sample of the processes summed: corner frequencies one octave apart, down to one period in ``n`` samples.

    Processes of equal power whose corners lie evenly on a log scale add up to a spectrum that falls as 1/f."""
    octaves = max(1, int(np.ceil(np.log2(n))))
    return np.exp(-np.pi / 2.0 ** np.arange(octaves))


def _innovations(seed: tuple[int, ...], length: int, decay: np.ndarray) -> np.ndarray:
    """(processes, length) driving noise of one block, of unit power after relaxation."""
    draws = np.random.default_rng(seed).standard_normal((len(decay), length))
    return draws * np.sqrt(1 - decay**2)[:, None]


def _relaxed(noise: np.ndarray, decay: np.ndarray, start: np.ndarray) -> np.ndarray:
    """s[t] = decay s[t-1] + noise[t] for every process, in pieces: a triangular product inside, one state in between."""
    k, n = noise.shape
    lag = np.arange(PIECE)[:, None] - np.arange(PIECE)[None, :]
    out = np.empty_like(noise)
    state = start.copy()
    for p in range(k):
        within = np.where(lag >= 0, decay[p] ** np.maximum(lag, 0), 0.0)
        lead = decay[p] ** np.arange(1, PIECE + 1)
        whole = np.zeros(-(-n // PIECE) * PIECE)
        whole[:n] = noise[p]
        local = whole.reshape(-1, PIECE) @ within.T
        for row in local:
            row += lead * state[p]
            state[p] = row[-1]
        out[p] = local.ravel()[:n]
    return out


def generate_pink_noise(specs: DataFrame) -> DataFrame:
    """1/f noise, zero mean, given RMS; long rows recording_id, t, ch, v.

    Input: recording_id (number or text), duration_s, fs, channels, amplitude_uv_rms, seed.

    A channel is a sum of first-order relaxation processes, drawn block by block from a seed of its own, so that a series
    of any length is made by many tasks: one pass gives each block's end state from silence, a fold over these few numbers
    per block gives the true states at its start, and sums over all blocks give mean and power.
    """
    rows = _checked(specs, "amplitude_uv_rms")
    short = F.raise_error(F.lit(f"pink noise needs at least {MIN_NOISE_SAMPLES} samples")).cast("long")
    rows = rows.withColumn("n", F.when(F.col("n") >= MIN_NOISE_SAMPLES, F.col("n")).otherwise(short))
    rows = rows.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("channels").cast("int") - 1)))
    rows = rows.select(
        F.col("recording_id").cast("string").alias("recording_id"),
        "ch",
        "n",
        F.col("amplitude_uv_rms").cast("double").alias("rms"),
        F.abs(F.col("seed").cast("long")).alias("seed"),
        F.shiftrightunsigned(F.xxhash64(F.col("recording_id").cast("string")), 1).alias("name"),
    )
    keys = ["recording_id", "ch"]
    blocks = rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    blocks = blocks.repartition(*keys, "b")

    def drawn(r: dict) -> tuple[np.ndarray, np.ndarray]:
        decay = _relaxations(r["n"])
        return decay, _innovations((r["seed"], r["name"], r["ch"], r["b"]), min(BLOCK, r["n"] - r["b"] * BLOCK), decay)

    def ends(batches):
        for batch in batches:
            for r in batch.to_pylist():
                decay, noise = drawn(r)
                weight = decay[:, None] ** np.arange(noise.shape[1] - 1, -1, -1)
                r["state"] = (noise * weight).sum(axis=1).tolist()
                yield pa.RecordBatch.from_pylist([r], schema=with_state)

    def starts(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        found = np.array(table.column("state").to_pylist())
        n = table.column("n")[0].as_py()
        seed = (table.column("seed")[0].as_py(), table.column("name")[0].as_py(), table.column("ch")[0].as_py())
        state = np.random.default_rng(seed).standard_normal(found.shape[1])  # stationary from the first sample on
        over = _relaxations(n) ** BLOCK
        out = []
        for end in found:
            out.append(state.tolist())
            state = over * state + end
        return table.set_column(table.schema.get_field_index("state"), "state", pa.array(out, pa.list_(pa.float64())))

    def sums(batches):
        for batch in batches:
            for r in batch.to_pylist():
                decay, noise = drawn(r)
                wave = _relaxed(noise, decay, np.array(r["state"])).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["recording_id"]]), pa.array([r["ch"]], pa.int32()), pa.array([wave.sum()]), pa.array([(wave**2).sum()])],
                    ["recording_id", "ch", "s", "s2"],
                )

    def waves(batches):
        for batch in batches:
            for r in batch.to_pylist():
                decay, noise = drawn(r)
                wave = _relaxed(noise, decay, np.array(r["state"])).sum(axis=0)
                wave = (wave - r["mean"]) * r["gain"]
                first = r["b"] * BLOCK
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["recording_id"]] * len(wave)),
                        pa.array(np.arange(first, first + len(wave))),
                        pa.array(np.full(len(wave), r["ch"], dtype=np.int32)),
                        pa.array(wave),
                    ],
                    ["recording_id", "t", "ch", "v"],
                )

    ddl = "recording_id string, ch int, n long, rms double, seed long, name long, b long, state array<double>"
    with_state = pa.schema(
        [("recording_id", pa.string()), ("ch", pa.int32()), ("n", pa.int64()), ("rms", pa.float64()), ("seed", pa.int64()),
         ("name", pa.int64()), ("b", pa.int64()), ("state", pa.list_(pa.float64()))]
    )
    states = blocks.mapInArrow(ends, ddl).groupBy(*keys).applyInArrow(starts, ddl)
    states = materialize(states, "noise-states")
    total = states.repartition(*keys, "b").mapInArrow(sums, "recording_id string, ch int, s double, s2 double")
    total = total.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    scaled = states.join(total, keys).withColumn("mean", F.col("s") / F.col("n"))
    power = F.sqrt(F.col("s2") / F.col("n") - F.col("mean") ** 2)
    scaled = scaled.withColumn("gain", F.col("rms") / power).drop("s", "s2")
    return scaled.repartition(*keys, "b").mapInArrow(waves, "recording_id string, t long, ch int, v double")


def widen(long: DataFrame) -> DataFrame:
    """Long rows back to one row per sample instant, channels in order."""
    packed = long.groupBy("recording_id", "t").agg(F.sort_array(F.collect_list(F.struct("ch", "v"))).alias("_c"))
    return packed.select("recording_id", "t", F.transform("_c", lambda s: s["v"]).alias("x"))
