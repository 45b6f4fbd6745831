"""Spatial filters: linear maps over the channels of every sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from wavetally.operators.blocks import Stage, apply_stages, zero_nan

# A model is one row per component; more than this is not a channel matrix.
MAX_MODEL_ROWS = 65536


def model_matrix(model: DataFrame, order: str, column: str) -> np.ndarray:
    """The rows of a model table as a matrix (components, channels)."""
    rows = model.select(order, column).limit(MAX_MODEL_ROWS + 1).collect()
    if len(rows) > MAX_MODEL_ROWS:
        raise ValueError("model has more rows than a channel matrix can have")
    return np.array([r[1] for r in sorted(rows, key=lambda r: r[0])], dtype=float)


def csp_stage(filters: np.ndarray, nan_to_zero: bool = True) -> Stage:
    weights = filters.T.copy()
    return Stage("csp", 0, lambda x: (zero_nan(x) if nan_to_zero else x) @ weights)


def ica_stage(unmixing: np.ndarray, mean: np.ndarray) -> Stage:
    weights, centre = unmixing.T.copy(), mean.copy()
    # a missing sample is 0 before centring
    return Stage("ica", 0, lambda x: (zero_nan(x) - centre) @ weights)


def csp_apply(signal: DataFrame, filters: DataFrame, nan_to_zero: bool = True) -> DataFrame:
    """y = x F^T with ``filters(component, x)``."""
    return apply_stages(signal, [csp_stage(model_matrix(filters, "component", "x"), nan_to_zero)])


def ica_apply(signal: DataFrame, model: DataFrame) -> DataFrame:
    """y = (x - mean) W^T with ``model(row, weights, mean)``."""
    weights = model_matrix(model, "row", "weights")
    mean = model_matrix(model, "row", "mean")[0]
    return apply_stages(signal, [ica_stage(weights, mean)])
