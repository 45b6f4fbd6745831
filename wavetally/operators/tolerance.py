"""Comparison of kernel outputs with expected values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.ordered import broadcast_if_small

# Relative and absolute tolerances per kernel, fixed values.
TOLERANCES = {
    "bandpass_fir": (1e-5, 1e-6),
    "car": (1e-5, 1e-6),
    "csp": (1e-4, 1e-4),
    "fft": (2e-4, 1e-5),
    "goertzel": (1e-5, 1e-6),
    "ica": (1e-4, 1e-5),
    "noop": (1e-7, 1e-9),
    "notch_iir": (1e-5, 1e-6),
    "welch_psd": (2e-3, 1e-4),
}

TINY = 1e-12


def tolerance_table(spark) -> DataFrame:
    rows = [(k, r, a) for k, (r, a) in TOLERANCES.items()]
    return spark.createDataFrame(rows, "plugin string, rtol double, atol double")


def kernel_tolerance_check(actual: DataFrame, expected: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Per (plugin, window): mismatches, largest errors, verdict.

    Inputs: plugin, window_index, i, ch, v. A value mismatches when both its
    absolute and its relative error are too large; non-finite values must be
    equal, and NaN equals nothing.
    """
    keys = ["plugin", "window_index", "i", "ch"]
    pairs = actual.select(*keys, F.col("v").cast("double").alias("a")).join(
        expected.select(*keys, F.col("v").cast("double").alias("e")), keys
    )
    pairs = pairs.join(broadcast_if_small(tolerances), "plugin")
    a, e = F.col("a"), F.col("e")

    def finite(c):
        return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    both = finite(a) & finite(e)
    err = F.abs(a - e)
    rel = err / (F.abs(e) + TINY)
    # Spark treats NaN as equal to itself; here it must not be
    equal = (a == e) & ~F.isnan(a) & ~F.isnan(e)
    bad = F.when(both, (err > F.col("atol")) & (rel > F.col("rtol"))).otherwise(~equal)
    return pairs.groupBy("plugin", "window_index").agg(
        F.count("*").alias("compared"),
        F.count_if(bad).alias("mismatches"),
        F.coalesce(F.max(F.when(both, err)), F.lit(0.0)).alias("max_abs_error"),
        F.coalesce(F.max(F.when(both, rel)), F.lit(0.0)).alias("max_rel_error"),
        F.bool_and(~bad).alias("passed"),
    )
