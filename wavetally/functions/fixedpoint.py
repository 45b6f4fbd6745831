"""Q15 arithmetic (16 bit, one sign bit, 15 fraction bits) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range and half-step of the number format, fixed values.
Q15_MAX = 32767
Q15_MIN = -32768
Q15_SCALE = 32768
Q15_HALF = 16384


def saturate(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(Q15_MAX).cast("long")), F.lit(Q15_MIN).cast("long")).cast("smallint")


def quantize_q15(x: Column, scale: float = 1.0) -> Column:
    """Round half away from zero to 1/32768 steps, saturate, NaN to 0."""
    scaled = x.cast("double") * F.lit(float(scale)) * F.lit(float(Q15_SCALE))
    bounded = F.greatest(F.least(scaled, F.lit(float(Q15_MAX))), F.lit(float(Q15_MIN)))
    rounded = F.when(bounded >= 0, F.floor(bounded + 0.5)).otherwise(F.ceil(bounded - 0.5))
    return F.when(F.isnan(x.cast("double")), F.lit(0).cast("smallint")).otherwise(rounded.cast("smallint"))


def dequantize_q15(q: Column) -> Column:
    return q.cast("double") / F.lit(float(Q15_SCALE))


def q15_sat_add(a: Column, b: Column) -> Column:
    return saturate(a.cast("long") + b.cast("long"))


def q15_sat_sub(a: Column, b: Column) -> Column:
    return saturate(a.cast("long") - b.cast("long"))


def q15_mul(a: Column, b: Column) -> Column:
    return saturate(F.shiftright(a.cast("long") * b.cast("long") + F.lit(Q15_HALF).cast("long"), 15))


def round_q30(acc: Column) -> Column:
    """A sum of Q15 products back to Q15."""
    return saturate(F.shiftright(acc + F.lit(Q15_HALF).cast("long"), 15))
