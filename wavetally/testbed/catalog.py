"""All registered queries."""

from wavetally.testbed import (  # noqa: F401
    comparison_queries,
    io_queries,
    signal_queries,
    streaming_queries,
    telemetry_queries,
)
from wavetally.testbed.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
