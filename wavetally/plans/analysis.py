"""Whole analyses over one table of telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wavetally.operators.series import freq_transitions, latency_ecdf, platform_timeline
from wavetally.operators.stats import chain_e2e, chain_stats, deadline_miss_rate, latency_stats, mean_ci
from wavetally.operators.telemetry import derive_frequency, derive_latency
from wavetally.plans.reports import summary_table


def full_analysis(telemetry: DataFrame) -> dict[str, DataFrame]:
    """Every table of the standard analysis, by name."""
    rows = derive_frequency(derive_latency(telemetry))
    return {
        "statistics": mean_ci(latency_stats(rows)),
        "deadlines": deadline_miss_rate(rows),
        "chain": chain_stats(rows),
        "chain_end_to_end": chain_e2e(rows),
        "ecdf": latency_ecdf(rows),
        "transitions": freq_transitions(rows),
        "timeline": platform_timeline(rows),
        "summary": summary_table(rows),
    }


def analyze_per_chain(telemetry: DataFrame) -> DataFrame:
    """Statistics per (pipeline folder, kernel), with deadline misses."""
    keys = ("pipeline", "plugin")
    rows = derive_latency(telemetry.where("pipeline is not null"))
    return mean_ci(latency_stats(rows, keys=keys)).join(deadline_miss_rate(rows, keys), list(keys))
