"""Report tables: formatted rows of summaries, comparisons, characterizations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.operators.stats import chain_e2e, chain_stats, deadline_miss_rate, latency_stats_tiers, mean_ci


def fixed(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, without grouping; what rounds to zero has no sign."""
    return F.format_string(f"%.{digits}f", F.round(c, digits))


def format_mean_ci(mean: Column, lower: Column, upper: Column, digits: int = 1, pct: Column | None = None) -> Column:
    """``mean ± half (pct%)``, or the mean alone without an interval."""
    half = F.concat(fixed(mean, digits), F.lit(" ± "), fixed((upper - lower) / 2, digits))
    if pct is not None:
        half = F.concat(half, F.when(pct.isNotNull(), F.concat(F.lit(" ("), fixed(pct, 1), F.lit("%)"))).otherwise(""))
    return F.when(lower.isNotNull() & upper.isNotNull(), half).otherwise(fixed(mean, digits))


def summary_table(df: DataFrame) -> DataFrame:
    """Rows (section, name, cells): the latency tiers, then deadline misses."""
    stats = mean_ci(latency_stats_tiers(df))

    def two(name: str) -> Column:
        return F.round(F.col(f"latency_us_{name}"), 2)

    mean = format_mean_ci(
        two("mean"), two("mean_ci_lower"), two("mean_ci_upper"), 2, two("mean_ci_pct")
    )
    numbers = [fixed(two(c), 2) for c in ("median", "p95", "p99", "min", "max", "std")]
    tiers = stats.select(
        F.col("tier").alias("section"),
        F.col("plugin").alias("name"),
        F.array(mean, *[F.coalesce(n, F.lit("N/A")) for n in numbers], F.col("sample_count").cast("string")).alias("cells"),
    )
    misses = deadline_miss_rate(df).select(
        F.lit("deadline").alias("section"),
        F.col("plugin").alias("name"),
        F.array(
            fixed(F.col("miss_rate"), 2), F.col("total_samples").cast("string"), F.col("deadline_misses").cast("string")
        ).alias("cells"),
    )
    return tiers.unionByName(misses)


def chain_section(df: DataFrame) -> DataFrame:
    """Chain part of the summary: one row per stage and one end-to-end row."""
    names = ("mean", "median", "p95", "p99")
    stages = chain_stats(df).select(
        F.lit("chain").alias("section"),
        F.concat_ws(" ", F.col("stage_index").cast("string"), "kernel").alias("name"),
        F.array(*[fixed(F.col(f"latency_us_{n}"), 2) for n in names], fixed(F.col("pct_contribution"), 1)).alias("cells"),
    )
    whole = chain_e2e(df).select(
        F.lit("chain_e2e").alias("section"),
        F.lit("end-to-end").alias("name"),
        F.array(*[fixed(F.col(c), 2) for c in ("e2e_mean", "e2e_p50", "e2e_p95", "e2e_p99")]).alias("cells"),
    )
    return stages.unionByName(whole)


def markdown_rows(table: DataFrame) -> DataFrame:
    """One text line per table row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.array("name"), F.col("cells"))), F.lit(" |"))
    return table.select("section", line.alias("line"))


def execution_mode(info: DataFrame) -> DataFrame:
    """Remote when device and host are both known and differ."""
    named = (F.coalesce("device_hostname", F.lit("")) != "") & (F.coalesce("os", F.lit("")) != "")
    differs = ~F.col("device_cpu").eqNullSafe(F.col("cpu")) | ~F.col("device_os").eqNullSafe(F.col("os"))
    remote = named & differs

    def pick(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit("Unknown"))

    return info.select(
        "plugin",
        F.when(remote, "Remote").otherwise("Local").alias("execution_mode"),
        F.when(remote, pick("device_cpu")).otherwise(pick("cpu", "device_cpu")).alias("shown_cpu"),
        F.when(remote, pick("device_os")).otherwise(pick("os", "device_os")).alias("shown_os"),
    )


def comparison_report(compared: DataFrame) -> DataFrame:
    """Formatted cells of a run comparison."""

    def text(name: str, digits: int) -> Column:
        return F.coalesce(fixed(F.col(name), digits), F.lit("N/A")).alias(name)

    def ci(side: str) -> Column:
        return format_mean_ci(
            F.col(f"{side}_mean"), F.col(f"{side}_mean_ci_lower"), F.col(f"{side}_mean_ci_upper"), 2
        ).alias(f"{side}_mean")

    bold = F.col("verdict").isin("IMPROVED", "REGRESSED")
    change = F.round("relative_change_pct", 2)
    return compared.select(
        "kernel",
        ci("baseline"),
        ci("candidate"),
        *[text(f"{s}_{p}", 2) for p in ("p50", "p95", "p99") for s in ("baseline", "candidate")],
        F.concat(F.when(change >= 0, "+").otherwise(""), fixed(change, 2)).alias("relative_change_pct"),
        text("cohens_d", 3),
        "effect_size_label",
        text("p_value", 4),
        F.when(bold, F.concat(F.lit("**"), "verdict", F.lit("**"))).otherwise(F.col("verdict")).alias("verdict"),
    )


def characterization_report(decomposed: DataFrame) -> DataFrame:
    """One JSON document per kernel with rounded figures and provenance."""

    def num(name: str, digits: int) -> Column:
        return F.round(F.col(name), digits).alias(name)

    shares = F.struct(
        *[F.round(f"{c}_share", 1).alias(c) for c in ("backend_stall_pct", "freq_mhz", "osnoise_total_ns")]
    )
    attribution = F.struct(
        "n_windows",
        "tier",
        num("tail_ratio", 3),
        num("noop_tail_ratio", 3),
        num("normalized_ratio", 3),
        "verdict",
        "tail_cohort_size",
        "typical_cohort_size",
        "covariate_comparisons",
        F.when(
            F.col("stable_freq_p99_us").isNotNull(),
            F.struct(
                F.round("stable_freq_p99_us", 2).alias("stable_p99_us"),
                F.round("unstable_freq_p99_us", 2).alias("unstable_p99_us"),
                F.col("freq_ks_pvalue").alias("ks_pvalue"),
            ),
        ).alias("freq_stratification"),
        F.when(
            F.col("model_r_squared").isNotNull(),
            F.struct(
                F.round("model_r_squared", 4).alias("model_r_squared"),
                shares.alias("attribution_pct"),
                F.round("algorithmic_residual_pct", 1).alias("algorithmic_residual_pct"),
            ),
        ).alias("shapley"),
    )
    doc = F.struct(
        F.col("plugin").alias("kernel"),
        *[num(c, 2) for c in ("best_us", "typical_us", "tail_us", "best_to_typical_gap_us", "tail_risk_us", "noop_p50_us")],
        num("ipc", 3),
        num("effective_freq_ghz", 3),
        *[num(c, 2) for c in ("frequency_tax_pct", "backend_stall_pct", "compute_time_us", "memory_stall_time_us")],
        "n_windows",
        "provenance",
        "unavailable",
        attribution.alias("tail_attribution"),
    )
    return decomposed.select("plugin", F.to_json(doc).alias("report"))
