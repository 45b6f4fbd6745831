"""Latency statistics per kernel, stage, condition and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.functions.special import t_critical
from wavetally.operators.ordered import GroupSizes, exact_percentiles, group_sizes
from wavetally.operators.telemetry import choose_latency_column, filter_warmup
from wavetally.schemas import NOT_CHAINED, finite_or_null, has

P50_P95_P99 = {"median": 0.5, "p95": 0.95, "p99": 0.99}

TIERS = {
    "kernel": "kernel_latency_us",
    "adapter": "adapter_latency_us",
    "end_to_end": "latency_us",
}


def _describe(df: DataFrame, keys: Sequence[str], value: str, exact: bool = True, sizes: GroupSizes | None = None) -> DataFrame:
    v = finite_or_null(F.col(value))
    moments = [
        F.avg(v).alias("latency_us_mean"),
        F.min(v).alias("latency_us_min"),
        F.max(v).alias("latency_us_max"),
        F.stddev_samp(v).alias("latency_us_std"),
        F.count(v).alias("sample_count"),
    ]
    marks = {f"latency_us_{a}": p for a, p in P50_P95_P99.items()}
    return exact_percentiles(df, keys, value, marks, exact=exact, sizes=sizes, aggs=moments)


def latency_stats(
    df: DataFrame, latency_column: str | None = None, keys: Sequence[str] = ("plugin",), exact: bool = True
) -> DataFrame:
    """Mean, median, p95, p99, min, max, standard deviation (n-1) and count of
    the warm rows of every kernel."""
    column = latency_column or choose_latency_column(df)
    if not has(df, column):
        raise ValueError(f"latency column {column!r} not found")
    return _describe(filter_warmup(df), keys, column, exact, group_sizes(df, keys) if exact else None)


def latency_stats_tiers(df: DataFrame, keys: Sequence[str] = ("plugin",), exact: bool = True) -> DataFrame:
    """The same for kernel, adapter and end-to-end time in one pass."""
    tiers = [F.struct(F.lit(t).alias("tier"), F.col(c).alias("tier_us")) for t, c in TIERS.items() if has(df, c)]
    long = filter_warmup(df).select(*keys, F.explode(F.array(*tiers)).alias("_t")).select(*keys, "_t.*")
    sizes = group_sizes(df, keys) if exact else None
    return _describe(long, ["tier", *keys], "tier_us", exact, sizes).where(F.col("sample_count") > 0)


def mean_ci(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Student-t interval of the mean; null for fewer than two samples."""
    mean, std, n = F.col("latency_us_mean"), F.col("latency_us_std"), F.col("sample_count")
    half = F.when((n >= 2) & std.isNotNull(), t_critical(F.lit(1 - alpha / 2), (n - 1).cast("double")) * std / F.sqrt(n))
    out = stats.withColumn("latency_us_mean_ci_half", half)
    h = F.col("latency_us_mean_ci_half")
    return (
        out.withColumn("latency_us_mean_ci_lower", mean - h)
        .withColumn("latency_us_mean_ci_upper", mean + h)
        .withColumn("latency_us_mean_ci_pct", F.when(mean != 0, h / mean * 100))
    )


def deadline_miss_rate(df: DataFrame, keys: Sequence[str] = ("plugin",)) -> DataFrame:
    """Rows, misses and percent; an unknown flag counts as missed."""
    missed = F.coalesce(F.col("deadline_missed").cast("int"), F.lit(1)) != 0
    return (
        filter_warmup(df)
        .groupBy(*keys)
        .agg(F.count("*").alias("total_samples"), F.count_if(missed).alias("deadline_misses"))
        .withColumn("miss_rate", F.col("deadline_misses") / F.col("total_samples") * 100)
    )


def check_deadline(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    rates = deadline_miss_rate(df)
    ok = F.col("miss_rate") <= threshold
    overall = rates.agg(F.bool_and(ok).alias("_all_ok"))
    return rates.crossJoin(overall).select(
        F.col("plugin").alias("kernel"),
        F.round("miss_rate", 4).alias("miss_rate"),
        "total_samples",
        "deadline_misses",
        F.lit(float(threshold)).alias("threshold"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        F.when(F.col("_all_ok"), "PASS").otherwise("FAIL").alias("overall"),
    )


def throughput_ops(stats: DataFrame) -> DataFrame:
    mean = F.col("latency_us_mean")
    return stats.withColumn("ops_per_sec", F.when(mean != 0, 1_000_000 / mean))


def harness_stats(df: DataFrame, keys: Sequence[str] = ("plugin",)) -> DataFrame:
    """Index percentiles, jitter, throughput and utilisation per kernel."""
    warm = filter_warmup(df).withColumn("_ns", F.col("end_ts_ns") - F.col("start_ts_ns"))
    us = F.col("_ns") / 1000.0
    first = F.min_by(
        F.struct("W", "H", "C", "Fs", (F.col("deadline_ts_ns") - F.col("release_ts_ns")).alias("budget_ns")),
        F.struct("release_ts_ns", "window_index"),
    )
    basic = [
        F.count("*").alias("windows"),
        F.count_if(F.coalesce(F.col("deadline_missed"), F.lit(1)) != 0).alias("deadline_misses"),
        F.avg(us).alias("mean_us"),
        F.stddev_pop(us).alias("stddev_us"),
        F.min(us).alias("min_us"),
        F.max(us).alias("max_us"),
        first.alias("_first"),
    ]
    marks = {"_p50": 0.5, "_p95": 0.95, "_p99": 0.99}
    rated = exact_percentiles(warm, keys, "_ns", marks, rule="index", sizes=group_sizes(df, keys), aggs=basic)
    p50, p95, p99 = (F.col(c) / 1000.0 for c in ("_p50", "_p95", "_p99"))
    f = F.col("_first")
    deadline_ms = F.when(f["budget_ns"] > 0, f["budget_ns"] / 1e6).otherwise(F.lit(0.0))
    return rated.select(
        *keys,
        "windows",
        "deadline_misses",
        (F.lit(100.0) * F.col("deadline_misses") / F.col("windows")).alias("miss_rate"),
        p50.alias("p50_us"),
        p95.alias("p95_us"),
        p99.alias("p99_us"),
        (p95 - p50).alias("jitter_p95_us"),
        (p99 - p50).alias("jitter_p99_us"),
        "min_us",
        "max_us",
        "mean_us",
        "stddev_us",
        F.when((f["H"] > 0) & (f["Fs"] > 0), f["Fs"] / f["H"]).otherwise(F.lit(0.0)).alias("windows_per_s"),
        F.when((f["W"] > 0) & (f["C"] > 0), p50 / (f["W"].cast("double") * f["C"]))
        .otherwise(F.lit(0.0))
        .alias("p50_us_per_ch_sample"),
        deadline_ms.alias("deadline_ms"),
        F.when(deadline_ms > 0, p99 / (deadline_ms * 1000.0) * 100.0).otherwise(F.lit(0.0)).alias("utilization_pct"),
    )


def run_metadata(df: DataFrame) -> DataFrame:
    release = F.col("release_ts_ns")
    return df.agg(
        F.coalesce((F.max(release) - F.min(release)) / 1e9, F.lit(0.0)).alias("duration_s"),
        F.max("repeat").alias("repeats"),
        F.count_if(F.col("warmup") != 0).alias("warmup_windows"),
        F.count_if(F.col("warmup") == 0).alias("collected_windows"),
    )


def distinct_plugins(df: DataFrame) -> DataFrame:
    """Kernel names with the place at which each is first seen."""
    return df.groupBy("plugin").agg(F.min(F.struct("release_ts_ns", "window_index")).alias("first_seen"))


# Bins of the latency histogram: up to p99 and above it, fixed values.
MAIN_BINS = 15
TAIL_BINS = 5


def latency_histogram(df: DataFrame, keys: Sequence[str] = ("plugin",)) -> DataFrame:
    """Fine bins from the minimum to p99, coarse bins above, empty bins kept.

    Kernels without variation have no histogram.
    """
    warm = filter_warmup(df).withColumn("_ns", F.col("end_ts_ns") - F.col("start_ts_ns"))
    warm = warm.select(*keys, "_ns", (F.col("_ns") / 1000.0).alias("_us"))
    sizes = group_sizes(df, keys)
    ends = [F.min("_us").alias("_min"), F.max("_us").alias("_max")]
    edges = (
        exact_percentiles(warm, keys, "_ns", {"_p": 0.99}, rule="index", sizes=sizes, aggs=ends)
        .where(F.col("_min") < F.col("_max"))
        .select(*keys, "_min", "_max", (F.col("_p") / 1000.0).alias("_p99"))
    )
    total = MAIN_BINS + TAIL_BINS
    us, lo, hi, p99 = F.col("_us"), F.col("_min"), F.col("_max"), F.col("_p99")

    def bins(offset: int, start, width, count: int, last: int):
        return F.least(F.lit(offset) + F.floor((us - start) / width * count), F.lit(last))

    bin_no = (
        F.when(p99 <= lo, bins(0, lo, hi - lo, total, total - 1))
        .when(us <= p99, bins(0, lo, p99 - lo, MAIN_BINS, MAIN_BINS - 1))
        .otherwise(bins(MAIN_BINS, p99, hi - p99, TAIL_BINS, total - 1))
    )
    filled = warm.join(sizes.small(edges), list(keys)).groupBy(*keys, bin_no.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("bin"))
    return grid.join(filled, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _chained(df: DataFrame) -> DataFrame:
    return filter_warmup(df).where(F.col("stage_index") != NOT_CHAINED)


def chain_stats(df: DataFrame) -> DataFrame:
    """Latency per chain stage and its share of the summed stage means."""
    rows = _chained(df)
    marks = {f"latency_us_{a}": p for a, p in P50_P95_P99.items()}
    basic = [
        F.avg(finite_or_null(F.col("latency_us"))).alias("latency_us_mean"),
        F.min_by("plugin", F.struct("run_id", "window_index")).alias("kernel"),
    ]
    sizes = group_sizes(df, ["stage_index"])
    stages = exact_percentiles(rows, ["stage_index"], "latency_us", marks, sizes=sizes, aggs=basic)
    total = stages.agg(F.sum("latency_us_mean").alias("_sum"))
    share = F.when(F.col("_sum") > 0, F.col("latency_us_mean") / F.col("_sum") * 100).otherwise(F.lit(0.0))
    return stages.crossJoin(total).withColumn("pct_contribution", share).drop("_sum")


def complete_windows(df: DataFrame) -> DataFrame:
    """Summed latency of the windows in which every stage of the table ran."""
    rows = _chained(df)
    stages = rows.agg(F.countDistinct("stage_index").alias("_stages"))
    per_window = rows.groupBy("run_id", "window_index").agg(
        F.countDistinct("stage_index").alias("_seen"), F.sum(finite_or_null(F.col("latency_us"))).alias("e2e_us")
    )
    return per_window.crossJoin(stages).where(F.col("_seen") == F.col("_stages")).drop("_seen", "_stages")


def chain_e2e(df: DataFrame) -> DataFrame:
    """One row: mean and percentiles over complete windows, zeros if none."""
    whole = complete_windows(df)
    basic = [F.count("*").alias("complete_windows"), F.avg("e2e_us").alias("e2e_mean")]
    marks = {"e2e_p50": 0.5, "e2e_p95": 0.95, "e2e_p99": 0.99}
    names = ["e2e_mean", *marks]
    # no more windows than rows; a table without complete windows has one row too
    sizes = GroupSizes(1, df.count())
    found = exact_percentiles(whole, [], "e2e_us", marks, sizes=sizes, aggs=basic)
    one = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("_none"))
    both = one.join(found, F.lit(True), "left").withColumn("complete_windows", F.coalesce("complete_windows", "_none"))
    return both.select("complete_windows", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def geo_mean_median(df: DataFrame, condition: str = "run_id", value: str = "latency_us") -> DataFrame:
    """Geometric mean, per condition, of the kernels' medians."""
    keys = [condition, "plugin"]
    medians = exact_percentiles(filter_warmup(df), keys, value, {"median": 0.5}, sizes=group_sizes(df, keys))
    return medians.groupBy(condition).agg(F.exp(F.avg(F.log("median"))).alias("geo_mean_us"))


def condition_ratio(df: DataFrame, baseline: str, condition: str = "run_id", value: str = "latency_us") -> DataFrame:
    """Geometric mean of every condition over that of ``baseline``; without the baseline the ratios are null."""
    means = geo_mean_median(df, condition, value)
    base = means.agg(F.max(F.when(F.col(condition) == baseline, F.col("geo_mean_us"))).alias("baseline_us"))
    return means.crossJoin(base).withColumn("ratio", F.try_divide(F.col("geo_mean_us"), F.col("baseline_us")))


def overhead_decomposition(df: DataFrame, condition: str = "run_id", value: str = "latency_us") -> DataFrame:
    """Floor over all conditions and how far each median lies above its minimum."""
    warm = filter_warmup(df)
    low = [F.min(finite_or_null(F.col(value))).alias("min_us")]
    sizes = group_sizes(df, [condition])
    lows = exact_percentiles(warm, [condition], value, {"median_us": 0.5}, sizes=sizes, aggs=low)
    floor = lows.agg(F.min("min_us").alias("overhead_floor_us"))
    return (
        lows.crossJoin(floor)
        .withColumn("penalty_us", F.col("median_us") - F.col("min_us"))
    )


def percentile_profile(df: DataFrame, keys: Sequence[str], value: str = "latency_us") -> DataFrame:
    warm = filter_warmup(df)
    v = finite_or_null(F.col(value))
    basic = [
        F.count(v).alias("n"),
        F.min(v).alias("min_us"),
        F.max(v).alias("max_us"),
        F.avg(v).alias("mean_us"),
        F.stddev_pop(v).alias("std_us"),
    ]
    marks = {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}
    return exact_percentiles(warm, keys, value, marks, sizes=group_sizes(df, keys), aggs=basic)


# Signal-to-noise limits, fixed values.
SNR_GOOD = 10.0
SNR_BORDERLINE = 8.0


def snr_table(df: DataFrame, noise_kernel: str = "noop", value: str = "latency_us") -> DataFrame:
    """Latency range of each kernel over the smallest latency of the noise kernel.

    Where that is 0 there is no ratio (null), and no limit is reached."""
    warm = filter_warmup(df)
    v = finite_or_null(F.col(value))
    noise = warm.where(F.col("plugin") == noise_kernel).agg(F.min(v).alias("overhead_us"))
    ranges = warm.where(F.col("plugin") != noise_kernel).groupBy("plugin").agg(F.min(v).alias("min_us"), F.max(v).alias("max_us"))
    worst = F.try_divide(F.col("min_us"), F.col("overhead_us"))
    return ranges.crossJoin(noise).select(
        "plugin",
        "min_us",
        "max_us",
        "overhead_us",
        worst.alias("snr_worst"),
        F.try_divide(F.col("max_us"), F.col("overhead_us")).alias("snr_best"),
        F.when(worst >= SNR_GOOD, "exceeds").when(worst >= SNR_BORDERLINE, "borderline").otherwise("below").alias("status"),
    )


def scaling_linearity(df: DataFrame) -> DataFrame:
    """Growth of file size against growth of channel count, and success rate.

    Input: channels, file_size_mb, success.
    """
    first = F.min_by("file_size_mb", "channels")
    last = F.max_by("file_size_mb", "channels")
    out = df.agg(
        F.count("*").alias("runs"),
        F.try_divide(F.max("channels"), F.min("channels")).alias("channel_factor"),
        F.when((first > 0) & (last > 0), last / first).alias("size_factor"),
        (F.count_if(F.col("success")) / F.count("*") * 100).alias("success_rate"),
    )
    linearity = F.when(F.col("runs") >= 2, F.try_divide(F.col("size_factor"), F.col("channel_factor")) * 100)
    return out.withColumn("linearity_pct", linearity).withColumn("is_linear", F.col("linearity_pct").between(95, 105))


def bytes_per_channel_sample(df: DataFrame) -> DataFrame:
    per = F.try_divide(F.col("file_size_mb") * (1024 * 1024), F.col("channels") * F.col("samples"))
    return df.withColumn("bytes_per_channel_sample", per)


def any_signal_flags(df: DataFrame) -> DataFrame:
    """Whether counters, stalls, noise and frequency carry any data."""
    warm = filter_warmup(df)

    def total(name: str):
        return F.coalesce(F.sum(F.col(name).cast("double")), F.lit(0.0)) if has(df, name) else F.lit(0.0)

    sums = warm.agg(
        total("pmu_cycle_count").alias("_cycles"),
        total("pmu_backend_stall_cycles").alias("_stalls"),
        total("osnoise_total_ns").alias("_noise"),
        total("freq_mhz").alias("_freq"),
    )
    pmu = F.col("_cycles") > 0 if has(df, "pmu_instruction_count") else F.lit(False)
    return sums.select(
        pmu.alias("has_pmu"),
        (pmu & (F.col("_stalls") > 0)).alias("has_stall"),
        (F.col("_noise") > 0).alias("has_osnoise"),
        (F.col("_freq") > 0).alias("has_freq"),
    )


def distinct_stage_count(df: DataFrame) -> DataFrame:
    return _chained(df).agg(F.countDistinct("stage_index").alias("stages"))
