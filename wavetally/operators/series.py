"""Ordered series: transitions, distribution curves, timelines, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.operators.ordered import group_sizes, number_rows, previous_values, repeat_rows, running_counts
from wavetally.operators.telemetry import filter_warmup
from wavetally.schemas import finite_or_null


MINUTE_NS = 60_000_000_000


def _with_frequency(df: DataFrame) -> DataFrame:
    return filter_warmup(df).where(F.col("freq_mhz") > 0)


def freq_transitions(df: DataFrame, keys: Sequence[str] = ("run_id", "plugin")) -> DataFrame:
    """Rows whose frequency differs from the window before, with the change in
    latency. Warm-up and zero frequency are removed first."""
    rows = _with_frequency(df).select(*keys, "window_index", "freq_mhz", "latency_us")
    seen = previous_values(rows, keys, "window_index", {"freq_mhz": "_freq", "latency_us": "_lat"})
    return seen.where(F.col("freq_mhz") != F.col("_freq")).select(
        *keys,
        "window_index",
        F.col("_freq").cast("int").alias("freq_before_mhz"),
        F.col("freq_mhz").cast("int").alias("freq_after_mhz"),
        F.col("_lat").alias("latency_before_us"),
        F.col("latency_us").alias("latency_after_us"),
        (F.col("latency_us") - F.col("_lat")).alias("latency_delta_us"),
    )


def latency_ecdf(df: DataFrame, value: str = "latency_us", keys: Sequence[str] = ("plugin",)) -> DataFrame:
    """Sorted latencies with rank and rank/n; equal values get distinct steps."""
    rows = filter_warmup(df).select(*keys, finite_or_null(F.col(value)).alias("value")).where("value is not null")
    counts = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    placed = running_counts(counts, keys, "value", ["n"], group_sizes(df, keys))
    steps = repeat_rows(placed, "n", "_i", [*keys, "value"])
    rank = F.col("n_before") + F.col("_i")
    return steps.select(*keys, "value", rank.alias("rank"), (rank / F.col("n_total")).alias("cdf"))


def common_kernels(base: DataFrame, cand: DataFrame) -> DataFrame:
    left = filter_warmup(base).select("plugin")
    return left.intersect(filter_warmup(cand).select("plugin")).orderBy("plugin")


def ecdf_compare(base: DataFrame, cand: DataFrame, value: str = "latency_us") -> DataFrame:
    """Distribution curves of two runs for the kernels both have."""
    both = base.withColumn("side", F.lit("baseline")).unionByName(
        cand.withColumn("side", F.lit("candidate")), allowMissingColumns=True
    )
    shared = both.join(common_kernels(base, cand), "plugin", "left_semi")
    return latency_ecdf(shared, value, ["side", "plugin"])


def platform_timeline(df: DataFrame, value: str = "latency_us") -> DataFrame:
    """Latency series of every kernel beside the frequency of the first one."""
    rows = _with_frequency(df)
    first = rows.agg(F.min_by("plugin", F.struct("release_ts_ns", "window_index", "plugin")).alias("_first"))
    freq = (
        rows.crossJoin(first)
        .where(F.col("plugin") == F.col("_first"))
        .select("run_id", "window_index", F.col("freq_mhz").alias("platform_freq_mhz"))
    )
    series = rows.select("run_id", "plugin", "window_index", F.col(value).alias("latency_us"))
    return series.join(freq, ["run_id", "window_index"], "left").select(
        "run_id", "plugin", "window_index", "latency_us", "platform_freq_mhz"
    )


def freq_latency_points(df: DataFrame) -> DataFrame:
    return _with_frequency(df).select("plugin", "freq_mhz", "latency_us")


def all_runs(df: DataFrame) -> DataFrame:
    """Runs with their latest release, newest first."""
    return df.groupBy("run_id").agg(F.max("release_ts_ns").alias("last_release_ns")).orderBy(F.desc("last_release_ns"))


def latest_run(df: DataFrame) -> DataFrame:
    runs = df.groupBy("run_id").agg(F.max("release_ts_ns").alias("last_release_ns"))
    return runs.agg(F.max_by("run_id", F.struct("last_release_ns", "run_id")).alias("run_id"))


def concat_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for other in runs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def filtered_slice(
    df: DataFrame, start: int, end: int, order: str = "release_ts_ns", plugin: str | None = None, span: int = MINUTE_NS
) -> DataFrame:
    """Records [start, end) in the order of a column, or of one kernel."""
    rows = df if plugin is None else df.where(F.col("plugin") == plugin)
    numbered = number_rows(rows, [], order, "_at", span)
    return numbered.where((F.col("_at") >= start) & (F.col("_at") < end)).drop("_at")
