"""Run-to-run comparison: tests, effect sizes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.functions.special import t_critical, t_pvalue
from wavetally.operators.ordered import exact_percentiles, group_sizes
from wavetally.operators.telemetry import choose_latency_column, filter_warmup
from wavetally.schemas import finite_or_null

# Fewest samples for a verdict, and effect-size limits; fixed values.
MIN_SAMPLES = 30
SMALL, MEDIUM, LARGE = 0.2, 0.5, 0.8


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return (
        F.when(d.isNull(), "N/A")
        .when(size < SMALL, "negligible")
        .when(size < MEDIUM, "small")
        .when(size < LARGE, "medium")
        .otherwise("large")
    )


def significance_code(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def welch_t(ma: Column, va: Column, na: Column, mb: Column, vb: Column, nb: Column) -> tuple[Column, Column]:
    """t and Welch-Satterthwaite degrees of freedom of a - b.

    Without any variance t is infinite for different means and NaN for equal.
    """
    ea, eb = va / na, vb / nb
    spread = ea + eb
    diff = ma - mb
    inf = F.lit(float("inf"))
    flat = F.when(diff > 0, inf).when(diff < 0, -inf).otherwise(F.lit(float("nan")))
    t = F.when(spread > 0, diff / F.sqrt(spread)).otherwise(flat)
    df = F.when(spread > 0, F.try_divide(spread * spread, ea * ea / (na - 1) + eb * eb / (nb - 1))).otherwise(na + nb - 2)
    enough = (na > 1) & (nb > 1)
    return F.when(enough, t), F.when(enough, df.cast("double"))


def _sides(df: DataFrame, condition: str, a, b, value: Column) -> DataFrame:
    """Per kernel the count, mean and variances of both sides, side by side."""
    rows = filter_warmup(df).where(F.col(condition).isin(a, b)).select("plugin", F.col(condition).alias("_side"), value.alias("_v"))

    def side(name: str, s) -> list[Column]:
        v = F.when(F.col("_side") == s, F.col("_v"))
        return [
            F.count(v).alias(f"n_{name}"),
            F.avg(v).alias(f"mean_{name}"),
            F.var_samp(v).alias(f"var_{name}"),
            F.var_pop(v).alias(f"pvar_{name}"),
        ]

    both = rows.groupBy("plugin").agg(*side("a", a), *side("b", b))
    return both.where((F.col("n_a") > 0) & (F.col("n_b") > 0))


def _t_of(sides: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("mean_a", "var_a", "n_a", "mean_b", "var_b", "n_b")]
    t, df = welch_t(*cols)
    return sides.select("plugin", "n_a", "n_b", "mean_a", "mean_b", t.alias("t"), df.alias("dof"))


def welch_ttest(df: DataFrame, a, b, condition: str = "run_id", value: str = "latency_us") -> DataFrame:
    tested = _t_of(_sides(df, condition, a, b, finite_or_null(F.col(value))))
    return tested.withColumn("p_value", t_pvalue("t", "dof"))


def log_welch_ttest(df: DataFrame, a, b, condition: str = "run_id", value: str = "latency_us") -> DataFrame:
    """The same on logarithms; values that have none are left out."""
    v = finite_or_null(F.col(value))
    tested = _t_of(_sides(df, condition, a, b, F.when(v > 0, F.log(v))))
    return tested.withColumn("p_value", t_pvalue("t", "dof")).withColumn("code", significance_code(F.col("p_value")))


def cohens_d_pop(df: DataFrame, a, b, condition: str = "run_id", value: str = "latency_us") -> DataFrame:
    """Effect size of a - b over the pooled population deviation, 0 if none."""
    sides = _sides(df, condition, a, b, finite_or_null(F.col(value)))
    pooled = F.sqrt((F.col("pvar_a") + F.col("pvar_b")) / 2)
    d = F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled).otherwise(F.lit(0.0))
    return sides.select("plugin", d.alias("cohens_d"), effect_label(d).alias("effect_size_label"))


def compare_verdict(
    n_base: Column, n_cand: Column, p: Column, d: Column, base_p50: Column, cand_p50: Column, alpha: float
) -> Column:
    return (
        F.when((n_base < MIN_SAMPLES) | (n_cand < MIN_SAMPLES), "LOW_N")
        .when(~F.coalesce(p < alpha, F.lit(False)), "NOISE")
        .when(F.coalesce(F.abs(d) < SMALL, F.lit(False)), "NEGLIGIBLE")
        .when(cand_p50 < base_p50, "IMPROVED")
        .when(cand_p50 > base_p50, "REGRESSED")
        .otherwise("NEGLIGIBLE")
    )


def compare_runs(base: DataFrame, cand: DataFrame, alpha: float = 0.05, value: str | None = None) -> DataFrame:
    """One row per kernel that both runs have."""
    if value is None:
        chosen = {choose_latency_column(base), choose_latency_column(cand)}
        value = "kernel_latency_us" if chosen == {"kernel_latency_us"} else "latency_us"
    v = finite_or_null(F.col(value)).alias("_lat")
    both = (
        filter_warmup(base).select(F.lit("baseline").alias("_side"), "plugin", v)
        .unionByName(filter_warmup(cand).select(F.lit("candidate").alias("_side"), "plugin", v))
    )
    keys, marks = ["_side", "plugin"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    lat = F.col("_lat")
    basic = [F.count(lat).alias("n"), F.avg(lat).alias("mean"), F.stddev_samp(lat).alias("_std")]
    stats = exact_percentiles(both, keys, "_lat", marks, sizes=group_sizes(both, keys), aggs=basic)
    stats = stats.where("n > 0").withColumn("std", F.when(F.col("n") > 1, F.col("_std")).otherwise(F.lit(0.0)))
    half = F.when(F.col("n") >= 2, t_critical(F.lit(1 - alpha / 2), (F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n"))
    stats = stats.withColumn("_half", half)

    def side(name: str) -> DataFrame:
        return stats.where(F.col("_side") == name).select(
            F.col("plugin").alias("kernel"),
            *[F.col(c).alias(f"{name}_{c}") for c in ("mean", "std", "n", "p50", "p95", "p99")],
            (F.col("mean") - F.col("_half")).alias(f"{name}_mean_ci_lower"),
            (F.col("mean") + F.col("_half")).alias(f"{name}_mean_ci_upper"),
        )

    joined = side("baseline").join(side("candidate"), "kernel")

    def c(name: str) -> Column:
        return F.col(name)

    b_var, c_var = c("baseline_std") * c("baseline_std"), c("candidate_std") * c("candidate_std")
    t, dof = welch_t(c("baseline_mean"), b_var, c("baseline_n"), c("candidate_mean"), c_var, c("candidate_n"))
    pooled = F.sqrt((b_var + c_var) / 2)
    shift = c("candidate_mean") - c("baseline_mean")
    inf = F.lit(float("inf"))
    d = F.when(
        (c("baseline_n") > 1) & (c("candidate_n") > 1),
        F.when(pooled > 0, shift / pooled).when(shift > 0, inf).when(shift < 0, -inf),
    )
    change = F.when(c("baseline_p50") > 0, (c("candidate_p50") - c("baseline_p50")) / c("baseline_p50") * 100).otherwise(F.lit(0.0))
    scored = joined.select("*", change.alias("relative_change_pct"), t.alias("t"), dof.alias("dof"), d.alias("cohens_d"))
    scored = scored.withColumn("p_value", t_pvalue("t", "dof"))
    verdict = compare_verdict(
        c("baseline_n"), c("candidate_n"), c("p_value"), c("cohens_d"), c("baseline_p50"), c("candidate_p50"), alpha
    )
    return (
        scored.withColumn("significant", F.coalesce(c("p_value") < alpha, F.lit(False)))
        .withColumn("effect_size_label", effect_label(c("cohens_d")))
        .withColumn("verdict", verdict)
    )
