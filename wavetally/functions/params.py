"""Typed values out of kernel parameter strings.

``"f0_hz: 60\\nQ: 30"`` and ``"f0_hz=60,Q=30"`` / ``"..&.."`` are accepted. A key
that is absent or whose value does not parse yields the default.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings, fixed values.
TRUE_WORDS = ["true", "yes", "1", "on"]
FALSE_WORDS = ["false", "no", "0", "off"]


def _raw(params: Column, key: str) -> Column:
    """Value text of the first occurrence of the key, null when absent."""
    pattern = rf"(?:^|[\n,&])\s*{re.escape(key)}\s*[:=]\s*([^\n,&]*)"
    text = F.when(params.rlike(pattern), F.rtrim(F.regexp_extract(params, pattern, 1)))
    quoted = text.rlike("^(\".*\"|'.*')$") & (F.length(text) >= 2)
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def param_float(params: Column, key: str, default: float) -> Column:
    text = _raw(params, key)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.coalesce(finite, F.lit(float(default)))


def param_int(params: Column, key: str, default: int) -> Column:
    text = _raw(params, key)
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return F.coalesce(number, F.lit(default).cast("long"))


def param_string(params: Column, key: str, default: str) -> Column:
    return F.coalesce(_raw(params, key), F.lit(default))


def param_bool(params: Column, key: str, default: bool) -> Column:
    word = F.lower(_raw(params, key))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(F.lit(default))
