"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks a telemetry row that is not part of a kernel chain (all ones, unsigned
# 32 bit); fixed value of the file format.
NOT_CHAINED = 4294967295

_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()

TELEMETRY = T.StructType(
    [
        T.StructField("run_id", _STR),
        T.StructField("plugin", _STR),
        T.StructField("window_index", _LONG),
        T.StructField("release_ts_ns", _LONG),
        T.StructField("deadline_ts_ns", _LONG),
        T.StructField("start_ts_ns", _LONG),
        T.StructField("end_ts_ns", _LONG),
        T.StructField("deadline_missed", _INT),
        T.StructField("W", _INT),
        T.StructField("H", _INT),
        T.StructField("C", _INT),
        T.StructField("Fs", _INT),
        T.StructField("warmup", _INT),
        T.StructField("repeat", _INT),
        T.StructField("device_tin_ns", _LONG),
        T.StructField("device_tstart_ns", _LONG),
        T.StructField("device_tend_ns", _LONG),
        T.StructField("device_tfirst_tx_ns", _LONG),
        T.StructField("device_tlast_tx_ns", _LONG),
        T.StructField("adapter_name", _STR),
        T.StructField("window_failed", _INT),
        T.StructField("error_code", _INT),
        T.StructField("cpu_freq_mhz", _INT),
        T.StructField("pmu_cycle_count", _LONG),
        T.StructField("pmu_instruction_count", _LONG),
        T.StructField("pmu_backend_stall_cycles", _LONG),
        T.StructField("osnoise_total_ns", _LONG),
        T.StructField("stage_index", _LONG),
        T.StructField("dtype", _INT),
    ]
)

SYSTEM_INFO = T.StructType(
    [
        T.StructField("_type", _STR),
        T.StructField("device_hostname", _STR),
        T.StructField("device_cpu", _STR),
        T.StructField("device_os", _STR),
        T.StructField("os", _STR),
        T.StructField("cpu", _STR),
    ]
)

# Rows some producers write already derived.
DERIVED = T.StructType([T.StructField("latency_ns", T.DoubleType())])

# One row per sample instant; ``x`` holds one value per channel.
SIGNAL = T.StructType(
    [
        T.StructField("recording_id", _STR),
        T.StructField("t", _LONG),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)


def has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def finite_or_null(c: Column) -> Column:
    """NaN becomes null, so aggregates skip it."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)
