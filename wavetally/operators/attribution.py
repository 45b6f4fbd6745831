"""Where tail latency comes from: platform, covariates or the kernel itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.functions.special import distance_pvalue, rank_test_pvalue
from wavetally.operators.ordered import GroupSizes, exact_percentiles, group_sizes, running_counts
from wavetally.operators.telemetry import filter_warmup
from wavetally.schemas import finite_or_null
from wavetally.session import materialize

NOOP = "noop"

# Verdict limits for the tail ratio, with and without a noop baseline; fixed values.
NORMALIZED_LIMITS = (1.5, 3.0)
RAW_LIMITS = (2.0, 5.0)

# Sample sizes and limits of the analysis tiers, fixed values.
TIER2_WINDOWS = 200
TIER3_WINDOWS = 500
MIN_COHORT = 5
MIN_STRATUM = 20
STABLE_SHARE = 0.02
SIGNIFICANT = 0.05

# Counted cycles say nothing about frequency below this kernel time, and a
# counter faster than this multiple of the maximum is a reference clock.
MIN_FREQ_US = 50.0
MAX_FREQ_FACTOR = 1.2

COVARIATES = ("backend_stall_pct", "freq_mhz", "osnoise_total_ns")

LATENCY = "kernel_latency_us"


def _verdict(ratio: Column, limits: tuple[float, float]) -> Column:
    low, high = limits
    return F.when(ratio < low, "platform-dominated").when(ratio <= high, "mixed").otherwise("algorithmic")


def _ratio(tail: Column, typical: Column) -> Column:
    return F.when(typical > 0, tail / typical).otherwise(F.lit(1.0))


def _with_verdict(df: DataFrame) -> DataFrame:
    """Needs tail_ratio and noop_tail_ratio (may be null)."""
    tail, noop = F.col("tail_ratio"), F.col("noop_tail_ratio")
    norm = F.when(noop.isNull(), F.lit(None).cast("double")).when(noop > 0, tail / noop).otherwise(tail)
    verdict = F.when(norm.isNotNull(), _verdict(norm, NORMALIZED_LIMITS)).otherwise(_verdict(tail, RAW_LIMITS))
    return df.withColumn("normalized_ratio", norm).withColumn("verdict", verdict)


def kernel_sizes(df: DataFrame) -> GroupSizes:
    """Counted once per table and handed to the steps below."""
    return group_sizes(df, ["plugin"])


def tail_ratio(df: DataFrame, value: str = LATENCY, noop: str = NOOP) -> DataFrame:
    """p99/p50 of every kernel, also relative to the noop kernel, and verdict."""
    warm = filter_warmup(df)
    marks = exact_percentiles(warm, ["plugin"], value, {"p50": 0.5, "p99": 0.99}, sizes=kernel_sizes(df))
    rated = marks.withColumn("tail_ratio", _ratio(F.col("p99"), F.col("p50")))
    base = rated.where(F.col("plugin") == noop).agg(F.max("tail_ratio").alias("noop_tail_ratio"))
    return _with_verdict(rated.where(F.col("plugin") != noop).crossJoin(base))


# ------------------------------------------------------------- characterization


def _metrics(df: DataFrame, value: str) -> dict[str, Column]:
    cycles = F.col("pmu_cycle_count").cast("double")
    device = F.col(value)
    counted = cycles > 0
    return {
        "latency": device,
        "outer": F.col("latency_us"),
        "overhead": F.col("latency_us") - device,
        "ipc": F.when(counted, F.col("pmu_instruction_count") / cycles),
        "freq_hz": F.when(counted & (device > 0), cycles / (device * 1e-6)),
        "stall": F.when(counted, F.col("pmu_backend_stall_cycles") / cycles),
    }


def _metric_marks(df: DataFrame, wanted: Sequence[str], value: str, sizes: GroupSizes | None = None) -> DataFrame:
    """p5, p50, p99 of several row-wise metrics of every kernel in one pass."""
    exprs = _metrics(df, value)
    stacked = F.array(*[F.struct(F.lit(m).alias("metric"), exprs[m].cast("double").alias("v")) for m in wanted])
    long = filter_warmup(df).select("plugin", F.explode(stacked).alias("_m")).select("plugin", "_m.*")
    probs, keys = {"p5": 0.05, "p50": 0.5, "p99": 0.99}, ["plugin", "metric"]
    counted = [F.count("v").alias("n")]
    marks = exact_percentiles(long, keys, "v", probs, sizes=sizes or kernel_sizes(df), aggs=counted)
    picks = [
        F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in wanted for p in ("n", "p5", "p50", "p99")
    ]
    return marks.groupBy("plugin").agg(*picks)


def harness_overhead(df: DataFrame, value: str = LATENCY) -> DataFrame:
    """Median of outer minus device time, and its share of median outer time."""
    m = _metric_marks(df, ["outer", "overhead"], value)
    pct = F.when(F.col("outer_p50") > 0, F.col("overhead_p50") / F.col("outer_p50") * 100).otherwise(F.lit(0.0))
    return m.select("plugin", F.col("overhead_p50").alias("overhead_us"), pct.alias("overhead_pct"))


def pmu_ipc(df: DataFrame) -> DataFrame:
    return _metric_marks(df, ["ipc"], LATENCY).select("plugin", F.col("ipc_p50").alias("ipc"))


def _frequency_columns(max_hz: float | None) -> tuple[Column, Column, Column]:
    """Effective GHz, frequency tax and reason when unavailable."""
    typical, hz = F.col("latency_p50"), F.col("freq_hz_p50")
    limit = F.lit(float(max_hz or 0.0))
    reference_clock = (limit > 0) & (hz > limit * MAX_FREQ_FACTOR)
    reason = (
        F.when(typical < MIN_FREQ_US, "kernel p50 below 50 us, counter overhead dominates")
        .when(hz.isNull(), "no valid cycle/wall-time pairs")
        .when(reference_clock, "cycle counter uses a fixed reference clock")
    )
    ghz = F.when(reason.isNull(), hz / 1e9)
    tax = F.when(reason.isNull() & (limit > 0), (1 - F.try_divide(hz, limit)) * 100)
    return ghz, tax, reason


def effective_frequency(df: DataFrame, max_hz: float | None = None, value: str = LATENCY) -> DataFrame:
    m = _metric_marks(df, ["latency", "freq_hz"], value)
    ghz, tax, reason = _frequency_columns(max_hz)
    return m.select(
        "plugin", ghz.alias("effective_freq_ghz"), tax.alias("frequency_tax_pct"), reason.alias("unavailable_reason")
    )


def stall_split(df: DataFrame, value: str = LATENCY) -> DataFrame:
    """Typical time split by the median share of stalled cycles."""
    m = _metric_marks(df, ["latency", "stall"], value)
    typical, share = F.col("latency_p50"), F.col("stall_p50")
    return m.select(
        "plugin",
        (share * 100).alias("backend_stall_pct"),
        (typical * (1 - share)).alias("compute_time_us"),
        (typical * share).alias("memory_stall_time_us"),
    )


def characterize(
    df: DataFrame, max_hz: float | None = None, value: str = LATENCY, noop: str = NOOP, sizes: GroupSizes | None = None
) -> DataFrame:
    """Landmarks, gaps, counters and tail verdict of every kernel but noop."""
    marks = _metric_marks(df, ["latency", "ipc", "freq_hz", "stall"], value, sizes)
    best, typical, tail = F.col("latency_p5"), F.col("latency_p50"), F.col("latency_p99")
    base = marks.where(F.col("plugin") == noop).agg(
        F.max("latency_p50").alias("noop_p50_us"), F.max(_ratio(tail, typical)).alias("noop_tail_ratio")
    )
    ghz, tax, reason = _frequency_columns(max_hz)
    share = F.col("stall_p50")
    rated = (
        marks.where(F.col("plugin") != noop)
        .crossJoin(base)
        .select(
            "plugin",
            best.alias("best_us"),
            typical.alias("typical_us"),
            tail.alias("tail_us"),
            F.greatest(typical - best, F.lit(0.0)).alias("best_to_typical_gap_us"),
            F.greatest(tail - typical, F.lit(0.0)).alias("tail_risk_us"),
            "noop_p50_us",
            F.col("ipc_p50").alias("ipc"),
            ghz.alias("effective_freq_ghz"),
            tax.alias("frequency_tax_pct"),
            (share * 100).alias("backend_stall_pct"),
            (typical * (1 - share)).alias("compute_time_us"),
            (typical * share).alias("memory_stall_time_us"),
            F.col("latency_n").alias("n_windows"),
            _ratio(tail, typical).alias("tail_ratio"),
            "noop_tail_ratio",
            reason.alias("_freq_reason"),
            F.lit(max_hz is not None).alias("_has_max"),
        )
    )
    return _with_verdict(rated)


def provenance_map(characterized: DataFrame) -> DataFrame:
    """Where each metric comes from, and why others are missing."""
    no_pmu = F.lit("no valid cycle counts")
    sources = {
        "best_us": (F.col("best_us"), "measured/timing/device", None),
        "typical_us": (F.col("typical_us"), "measured/timing/device", None),
        "tail_us": (F.col("tail_us"), "measured/timing/device", None),
        "noop_p50_us": (F.col("noop_p50_us"), "measured/timing/noop", None),
        "ipc": (F.col("ipc"), "measured/PMU", no_pmu),
        "effective_freq_ghz": (F.col("effective_freq_ghz"), "measured/PMU+timing", F.col("_freq_reason")),
        "frequency_tax_pct": (
            F.col("frequency_tax_pct"),
            "measured/PMU+timing",
            F.coalesce(F.col("_freq_reason"), F.lit("no maximum frequency given")),
        ),
        "backend_stall_pct": (F.col("backend_stall_pct"), "measured/PMU", no_pmu),
        "compute_time_us": (F.col("compute_time_us"), "measured/PMU+timing", no_pmu),
        "memory_stall_time_us": (F.col("memory_stall_time_us"), "measured/PMU+timing", no_pmu),
        "tail_ratio": (F.col("tail_ratio"), "measured/timing/device", None),
    }

    def as_map(pairs) -> Column:
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    present = [(k, F.when(c.isNotNull(), F.lit(s))) for k, (c, s, _) in sources.items()]
    missing = [(k, F.when(c.isNull(), why)) for k, (c, _, why) in sources.items() if why is not None]
    return characterized.withColumn("provenance", as_map(present)).withColumn("unavailable", as_map(missing))


# --------------------------------------------------------------- cohorts, tests


def stall_covariate(df: DataFrame) -> DataFrame:
    """Stalled share of the cycles, 0 where none were counted."""
    cycles = F.col("pmu_cycle_count")
    return df.withColumn(
        "backend_stall_pct", F.when(cycles > 0, F.col("pmu_backend_stall_cycles") / cycles).otherwise(F.lit(0.0))
    )


def _covariate_names() -> Column:
    """Aggregate: names of the covariates with any non-zero value."""
    seen = [F.when(F.max(F.coalesce(F.col(c), F.lit(0)) != 0), F.lit(c)) for c in COVARIATES]
    return F.array_compact(F.array(*seen))


def present_covariates(df: DataFrame) -> DataFrame:
    """Per kernel the covariates with any non-zero value, and the row count."""
    named = [F.count("*").alias("n_windows"), _covariate_names().alias("covariates")]
    return filter_warmup(df).groupBy("plugin").agg(*named)


def tail_cohorts(
    df: DataFrame, value: str = LATENCY, noop: str = NOOP, sizes: GroupSizes | None = None
) -> DataFrame:
    """Rows of the tail (> p95) and of the typical half (p25..p75).

    Kernels with fewer than 200 windows, no covariates or a cohort below 5 rows
    have none. Input needs the covariate columns.
    """
    sizes = sizes or kernel_sizes(df)
    rows = filter_warmup(df).where(F.col("plugin") != noop)
    probs = {"_p25": 0.25, "_p75": 0.75, "_p95": 0.95}
    known = [F.count("*").alias("n_windows"), _covariate_names().alias("covariates")]
    limits = exact_percentiles(rows, ["plugin"], value, probs, sizes=sizes, aggs=known)
    limits = limits.where((F.col("n_windows") >= TIER2_WINDOWS) & (F.size("covariates") > 0)).drop("n_windows")
    v = F.col(value)
    cohort = F.when(v > F.col("_p95"), "tail").when((v >= F.col("_p25")) & (v <= F.col("_p75")), "typical")
    labelled = rows.join(sizes.small(limits), "plugin").withColumn("cohort", cohort).where("cohort is not null")
    counted = labelled.groupBy("plugin").agg(
        F.count_if(F.col("cohort") == "tail").alias("tail_cohort_size"),
        F.count_if(F.col("cohort") == "typical").alias("typical_cohort_size"),
    )
    big = counted.where((F.col("tail_cohort_size") >= MIN_COHORT) & (F.col("typical_cohort_size") >= MIN_COHORT))
    return labelled.join(sizes.small(big), "plugin").drop("_p25", "_p75", "_p95")


def cohort_table(df: DataFrame, value: str = LATENCY, noop: str = NOOP, sizes: GroupSizes | None = None) -> DataFrame:
    """The covariates of the cohorts, written once: finding them takes a
    percentile pass, and several tests read them."""
    wanted = ["plugin", "cohort", "covariates", *COVARIATES, "tail_cohort_size", "typical_cohort_size"]
    return materialize(tail_cohorts(df, value, noop, sizes).select(*wanted), "tail-cohorts")


def _covariate_rows(cohorts: DataFrame) -> DataFrame:
    stacked = F.array(
        *[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in COVARIATES]
    )
    used = F.filter(stacked, lambda s: F.array_contains(F.col("covariates"), s["covariate"]))
    return cohorts.select("plugin", "cohort", F.explode(used).alias("_c")).select("plugin", "cohort", "_c.*")


def mann_whitney_u(
    rows: DataFrame, keys: Sequence[str], value: str, first: Column, sizes: GroupSizes | None = None
) -> DataFrame:
    """Two-sided rank test of the rows marked ``first`` against the others.

    Average ranks for ties. p is exact where the smaller side has at most eight rows and nothing is tied, else from the normal
    limit with tie and continuity correction.
    """
    src = rows.select(*keys, finite_or_null(F.col(value)).alias("_v"), first.alias("_f")).where("_v is not null")
    counts = src.groupBy(*keys, "_v").agg(F.count("*").alias("n"), F.count_if("_f").alias("n1"))
    ranked = running_counts(counts, keys, "_v", ["n"], sizes or group_sizes(rows, keys))
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n1").alias("n_first"),
        F.sum(F.col("n") - F.col("n1")).alias("n_second"),
        F.sum(F.col("n1") * rank).alias("_r1"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    total = n1 + n2
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (total + 1 - F.try_divide(F.col("_ties"), total * (total - 1)))
    far = F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5
    z = F.when(var > 0, F.greatest(far / F.sqrt(var), F.lit(0.0))).otherwise(F.lit(0.0))
    found = sums.select(*keys, "n_first", "n_second", u1.alias("u"), z.alias("z"), "_ties")
    return found.withColumn("p_value", rank_test_pvalue("z", "u", "n_first", "n_second", "_ties")).drop("_ties")


def cohort_compare(cohorts: DataFrame, sizes: GroupSizes | None = None) -> DataFrame:
    """Medians of every covariate in both cohorts, rank test and direction."""
    sizes = sizes or kernel_sizes(cohorts)
    rows = _covariate_rows(cohorts)
    marks = exact_percentiles(rows, ["plugin", "covariate", "cohort"], "v", {"median": 0.5}, sizes=sizes)
    medians = marks.groupBy("plugin", "covariate").agg(
        F.max(F.when(F.col("cohort") == "tail", F.col("median"))).alias("tail_median"),
        F.max(F.when(F.col("cohort") == "typical", F.col("median"))).alias("typical_median"),
    )
    tested = mann_whitney_u(rows, ["plugin", "covariate"], "v", F.col("cohort") == "tail", sizes)
    significant = F.coalesce(F.col("p_value") < SIGNIFICANT, F.lit(False))
    direction = (
        F.when(~significant, "no_difference")
        .when(F.col("tail_median") > F.col("typical_median"), "higher_in_tail")
        .otherwise("lower_in_tail")
    )
    return medians.join(tested, ["plugin", "covariate"]).select(
        "plugin", "covariate", "tail_median", "typical_median", "u", "p_value",
        significant.alias("significant"), direction.alias("direction"),
    )


def ks_two_sample(
    rows: DataFrame, keys: Sequence[str], value: str, first: Column, sizes: GroupSizes | None = None
) -> DataFrame:
    """Largest distance of the two distribution curves and its p-value, exact up to 10,000 rows on a side, else from the limit."""
    src = rows.select(*keys, finite_or_null(F.col(value)).alias("_v"), first.alias("_f")).where("_v is not null")
    counts = src.groupBy(*keys, "_v").agg(F.count_if("_f").alias("a"), F.count_if(~F.col("_f")).alias("b"))
    run = running_counts(counts, keys, "_v", ["a", "b"], sizes or group_sizes(rows, keys))
    gap = F.abs((F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total"))
    run = run.where((F.col("a_total") > 0) & (F.col("b_total") > 0))
    best = run.groupBy(*keys).agg(
        F.max("a_total").alias("n_first"), F.max("b_total").alias("n_second"), F.max(gap).alias("d")
    )
    return best.withColumn("p_value", distance_pvalue("d", "n_first", "n_second"))


def freq_stratification(
    df: DataFrame, value: str = LATENCY, noop: str = NOOP, sizes: GroupSizes | None = None
) -> DataFrame:
    """p99 of windows near the median frequency and of the others, with a
    distribution test; only kernels with 20 windows on both sides."""
    sizes = sizes or kernel_sizes(df)
    # written once, as are the strata: every percentile and the test take several passes
    rows = filter_warmup(df).where(F.col("plugin") != noop).select("plugin", "freq_mhz", F.col(value).alias("v"))
    rows = materialize(rows, "frequencies")
    known = [F.count("*").alias("n_windows"), F.max(F.coalesce(F.col("freq_mhz"), F.lit(0)) != 0).alias("has_freq")]
    centre = exact_percentiles(rows, ["plugin"], "freq_mhz", {"_f50": 0.5}, sizes=sizes, aggs=known)
    centre = centre.where((F.col("n_windows") >= TIER2_WINDOWS) & F.col("has_freq")).select("plugin", "_f50")
    stable = F.abs(F.col("freq_mhz") - F.col("_f50")) < F.col("_f50") * STABLE_SHARE
    split = rows.join(sizes.small(centre), "plugin").select("plugin", "v", stable.alias("stable"))
    split = materialize(split, "strata")
    count = [F.count("*").alias("n")]
    marks = exact_percentiles(split, ["plugin", "stable"], "v", {"p99": 0.99}, sizes=sizes, aggs=count)

    def side(flag: bool, name: str) -> Column:
        return F.max(F.when(F.col("stable") == flag, F.col(name)))

    strata = marks.groupBy("plugin").agg(
        side(True, "n").alias("stable_n"),
        side(False, "n").alias("unstable_n"),
        side(True, "p99").alias("stable_freq_p99_us"),
        side(False, "p99").alias("unstable_freq_p99_us"),
    )
    strata = strata.where((F.col("stable_n") >= MIN_STRATUM) & (F.col("unstable_n") >= MIN_STRATUM))
    ks = ks_two_sample(split, ["plugin"], "v", F.col("stable"), sizes)
    return strata.join(
        ks.select("plugin", F.col("d").alias("ks_distance"), F.col("p_value").alias("freq_ks_pvalue")), "plugin"
    )


# ------------------------------------------------------------ variance shares

SINGULAR = 1e-12


def regression_inputs(df: DataFrame) -> DataFrame:
    """Covariates as regressors: stall share, 1/frequency, log(1 + noise)."""
    freq = F.col("freq_mhz")
    return (
        df.withColumn("_x1", F.col("backend_stall_pct"))
        .withColumn("_x2", 1.0 / F.when(freq > 0, freq).otherwise(F.lit(1.0)))
        .withColumn("_x3", F.log1p(F.col("osnoise_total_ns").cast("double")))
    )


def ols_r2_subsets(df: DataFrame, value: str = LATENCY, noop: str = NOOP) -> DataFrame:
    """R^2 of the regressions on every subset of the three covariates.

    One pass of pair correlations; R^2 follows from them in closed form. A
    constant covariate explains nothing; of dependent ones the best subset counts.
    """
    rows = regression_inputs(filter_warmup(df).where(F.col("plugin") != noop)).withColumn("_y", F.col(value))

    def corr(a: str, b: str) -> Column:
        # the built-in correlation fails on a constant column
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        return F.coalesce(finite_or_null(r), F.lit(0.0)).alias(f"{a}{b}")

    pairs = [("_y", "_x1"), ("_y", "_x2"), ("_y", "_x3"), ("_x1", "_x2"), ("_x1", "_x3"), ("_x2", "_x3")]
    c = rows.groupBy("plugin").agg(F.count("*").alias("n_windows"), *[corr(a, b) for a, b in pairs])
    y1, y2, y3 = F.col("_y_x1"), F.col("_y_x2"), F.col("_y_x3")
    a, b, g = F.col("_x1_x2"), F.col("_x1_x3"), F.col("_x2_x3")
    zero = F.lit(0.0)

    def two(p: Column, q: Column, pq: Column) -> Column:
        den = 1 - pq * pq
        return F.when(den > SINGULAR, (p * p + q * q - 2 * p * q * pq) / den).otherwise(F.greatest(p * p, q * q))

    singles = c.withColumn("r2_1", y1 * y1).withColumn("r2_2", y2 * y2).withColumn("r2_3", y3 * y3)
    doubles = (
        singles.withColumn("r2_12", two(y1, y2, a)).withColumn("r2_13", two(y1, y3, b)).withColumn("r2_23", two(y2, y3, g))
    )
    det = 1 + 2 * a * b * g - a * a - b * b - g * g
    top = (
        y1 * y1 * (1 - g * g) + y2 * y2 * (1 - b * b) + y3 * y3 * (1 - a * a)
        - 2 * y1 * y2 * (a - b * g) - 2 * y1 * y3 * (b - a * g) - 2 * y2 * y3 * (g - a * b)
    )
    full = F.when(det > SINGULAR, top / det).otherwise(F.greatest("r2_12", "r2_13", "r2_23"))
    out = doubles.withColumn("r2_123", full)
    names = ["r2_1", "r2_2", "r2_3", "r2_12", "r2_13", "r2_23", "r2_123"]
    return out.select("plugin", "n_windows", *[F.greatest(F.col(n), zero).alias(n) for n in names])


def shapley_r2(df: DataFrame, value: str = LATENCY, noop: str = NOOP) -> DataFrame:
    """Share of the latency variance each covariate explains, averaged over all
    orders of adding them, and the unexplained rest (percent).

    Only kernels with 500 windows and two covariates; a covariate without data
    has a null share (it explains nothing, so the others are unaffected).
    """
    r = ols_r2_subsets(df, value, noop)
    known = present_covariates(df).select("plugin", "covariates")
    ready = r.join(known, "plugin").where(
        (F.col("n_windows") >= TIER3_WINDOWS) & (F.size("covariates") >= 2) & (F.col("r2_123") > 0)
    )

    def share(i: str, j: str, k: str) -> Column:
        def of(*names: str) -> Column:
            return F.col("r2_" + "".join(sorted(names)))

        return (
            of(i) / 3 + (of(i, j) - of(j)) / 6 + (of(i, k) - of(k)) / 6 + (of(i, j, k) - of(j, k)) / 3
        ) * 100

    def kept(name: str, c: Column) -> Column:
        return F.when(F.array_contains("covariates", F.lit(name)), c).alias(f"{name}_share")

    return ready.select(
        "plugin",
        "n_windows",
        F.col("r2_123").alias("model_r_squared"),
        kept("backend_stall_pct", share("1", "2", "3")),
        kept("freq_mhz", share("2", "1", "3")),
        kept("osnoise_total_ns", share("3", "1", "2")),
        ((1 - F.col("r2_123")) * 100).alias("algorithmic_residual_pct"),
    )


def cohort_sizes(cohorts: DataFrame) -> DataFrame:
    return cohorts.groupBy("plugin").agg(
        F.max("tail_cohort_size").alias("tail_cohort_size"), F.max("typical_cohort_size").alias("typical_cohort_size")
    )


def attribution_tier(df: DataFrame, value: str = LATENCY, noop: str = NOOP) -> DataFrame:
    """Highest analysis tier every kernel reaches."""
    kernels = filter_warmup(df).where(F.col("plugin") != noop).groupBy("plugin").agg(F.count("*").alias("n_windows"))
    sizes = kernel_sizes(df)
    second = cohort_sizes(tail_cohorts(df, value, noop, sizes))
    third = shapley_r2(df, value, noop).select("plugin", F.lit(True).alias("_third"))
    tier = F.when(F.col("tail_cohort_size").isNull(), 1).when(F.col("_third"), 3).otherwise(2)
    return kernels.join(second, "plugin", "left").join(third, "plugin", "left").select(
        "plugin", "n_windows", "tail_cohort_size", "typical_cohort_size", tier.alias("tier")
    )


def decompose_run(df: DataFrame, max_hz: float | None = None, value: str = LATENCY, noop: str = NOOP) -> DataFrame:
    """Characterization and attribution of every kernel in one row each."""
    sizes = kernel_sizes(df)
    # written once: the steps below take some ten passes over these columns, whatever came before them
    used = {"plugin", "warmup", value, "latency_us", "pmu_instruction_count", "pmu_cycle_count", "pmu_backend_stall_cycles", *COVARIATES}
    rows = stall_covariate(df)
    rows = materialize(rows.select(*[c for c in rows.columns if c in used]), "decomposed-rows")
    described = provenance_map(characterize(rows, max_hz, value, noop, sizes)).drop("_freq_reason", "_has_max")
    cohorts = cohort_table(rows, value, noop, sizes)
    tests = cohort_compare(cohorts, sizes)
    tests = tests.groupBy("plugin").agg(
        F.sort_array(
            F.collect_list(F.struct("covariate", "tail_median", "typical_median", "p_value", "significant", "direction"))
        ).alias("covariate_comparisons")
    )
    cohort_n = cohort_sizes(cohorts)
    strata = freq_stratification(rows, value, noop, sizes).drop("stable_n", "unstable_n", "ks_distance")
    shares = shapley_r2(rows, value, noop).drop("n_windows")
    out = described.join(cohort_n, "plugin", "left").join(tests, "plugin", "left")
    out = out.join(strata, "plugin", "left").join(shares, "plugin", "left")
    second = F.col("tail_cohort_size").isNotNull()
    tier = F.when(~second, 1).when(F.col("model_r_squared").isNotNull(), 3).otherwise(2)
    # tiers build on each other
    for name in ("stable_freq_p99_us", "unstable_freq_p99_us", "freq_ks_pvalue", "model_r_squared",
                 "algorithmic_residual_pct", *[f"{c}_share" for c in COVARIATES]):
        out = out.withColumn(name, F.when(second, F.col(name)))
    return out.withColumn("tier", tier)
