"""Telemetry: derived columns, filters, statistics, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetally.functions import params as P
from wavetally.operators import series, stats
from wavetally.operators import telemetry as tel
from wavetally.testbed import tables
from wavetally.testbed.registry import query, r, rounded
from wavetally.testbed.tables import F1, F2


def derived(spark, d, numbered=False):
    return tel.derive_frequency(tel.derive_latency(tables.telemetry(spark, d, numbered)))


def chained(spark, d):
    return tel.derive_latency(tables.chain_telemetry(spark, d))


def runs(spark, d):
    rows = derived(spark, d)
    return rows.where("run_id = 'base'"), rows.where("run_id = 'cand'")


KEY = "run_id, plugin, window_index"

# ------------------------------------------------------------ derived columns


@query(
    "derive_latency",
    f"WITH {F1} SELECT {KEY}, latency_ns, {r('latency_us', 'latency_us')}, {r('kernel_latency_us', 'kernel_latency_us')}, "
    f"{r('adapter_latency_us', 'adapter_latency_us')}, {r('e2e_latency_us', 'e2e_latency_us')} FROM f1d",
)
def _(spark, d):
    out = tel.derive_latency(tables.telemetry(spark, d))
    cols = ["latency_ns", "latency_us", "kernel_latency_us", "adapter_latency_us", "e2e_latency_us"]
    return rounded(out.select("run_id", "plugin", "window_index", *cols))


@query("derive_frequency", f"WITH {F1} SELECT {KEY}, {r('freq_mhz', 'freq_mhz')} FROM f1d")
def _(spark, d):
    return rounded(derived(spark, d, True).select("run_id", "plugin", "window_index", "freq_mhz"))


@query(
    "classify_deadline",
    f"""WITH {F1} SELECT {KEY}, release_ts_ns + 500000000 AS deadline_ts_ns,
    CASE WHEN end_ts_ns > release_ts_ns + 500000000 THEN 1 ELSE 0 END AS deadline_missed FROM f1""",
)
def _(spark, d):
    out = tel.classify_deadline(tables.telemetry(spark, d))
    return out.select("run_id", "plugin", "window_index", "deadline_ts_ns", "deadline_missed")


@query(
    "tag_warmup",
    f"""WITH {F1} SELECT {KEY}, CASE WHEN row_number() OVER (PARTITION BY run_id, plugin ORDER BY window_index)
    <= floor(30 * Fs / H) THEN 1 ELSE 0 END AS warmup FROM f1""",
)
def _(spark, d):
    return tel.tag_warmup(tables.telemetry(spark, d), 30).select("run_id", "plugin", "window_index", "warmup")


@query("filter_warmup", f"WITH {F1} SELECT {KEY}, end_ts_ns FROM warm")
def _(spark, d):
    return tel.filter_warmup(tables.telemetry(spark, d)).select("run_id", "plugin", "window_index", "end_ts_ns")


@query(
    "filter_kernels",
    f"""WITH {F1} SELECT plugin, CASE plugin WHEN 'signup' THEN 1 WHEN 'noop' THEN 3 ELSE 4 END AS list_position,
    count(*) AS n FROM f1 WHERE plugin IN ('signup', 'noop', 'click') GROUP BY ALL""",
)
def _(spark, d):
    kept = tel.filter_kernels(tables.telemetry(spark, d), " signup, missing ,noop,,click\t")
    return kept.groupBy("plugin", "list_position").agg(F.count("*").alias("n"))


@query(
    "choose_latency_column",
    f"""WITH {F1} SELECT plugin, CASE WHEN (SELECT count(kernel_latency_us) FROM warm) > 0
    THEN 'kernel_latency_us' ELSE 'latency_us' END AS latency_column FROM f1d GROUP BY plugin""",
)
def _(spark, d):
    rows = derived(spark, d)
    return rows.select("plugin").distinct().withColumn("latency_column", F.lit(tel.choose_latency_column(rows)))


@query(
    "adapter_overhead",
    f"""WITH {F1} SELECT {KEY}, (device_tin_ns - start_ts_ns) + (end_ts_ns - device_tlast_tx_ns) AS adapter_overhead_ns
    FROM f1""",
)
def _(spark, d):
    out = tel.adapter_overhead(tables.telemetry(spark, d))
    return out.select("run_id", "plugin", "window_index", "adapter_overhead_ns")


@query("sort_series", f"WITH {F1} SELECT plugin, window_index, run_id, {r('latency_us', 'latency_us')} FROM f1d ORDER BY 1, 2")
def _(spark, d):
    return rounded(tel.sort_series(derived(spark, d, True)).select("plugin", "window_index", "run_id", "latency_us"))


@query(
    "labels_from_pattern",
    """WITH s AS (SELECT s_suppkey, s_suppkey % 7 AS a, s_suppkey % 5 + 1 AS b FROM supplier)
    SELECT s_suppkey, unnest(range(a + b)) AS window_index,
           CASE WHEN unnest(range(a + b)) < a THEN 0 ELSE 1 END AS label FROM s""",
)
def _(spark, d):
    pattern = F.concat(
        (F.col("s_suppkey") % 7).cast("string"), F.lit("x0, "), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit("x1")
    )
    rows = tables.read(spark, d, "supplier").select("s_suppkey", pattern.alias("pattern"))
    return tel.labels_from_pattern(rows, "pattern", ["s_suppkey"])


@query(
    "validate_window_config",
    """WITH c AS (SELECT p_partkey, p_size % 4 * 80 AS Fs, p_partkey % 9 * 8 AS C, p_size * 8 AS W,
      p_partkey % 60 * 4 AS H, p_retailprice AS deadline_ms FROM part)
    SELECT p_partkey, CASE WHEN Fs <= 0 THEN 'Fs must be > 0' WHEN C <= 0 THEN 'C must be > 0'
      WHEN W <= 0 THEN 'window length must be > 0' WHEN H <= 0 OR H > W THEN 'invalid hop/window'
      WHEN deadline_ms > 0 AND deadline_ms < 1000.0::DOUBLE * H / Fs THEN 'deadline too tight' END AS problem FROM c""",
)
def _(spark, d):
    rows = tables.read(spark, d, "part").selectExpr(
        "p_partkey", "p_size % 4 * 80 AS Fs", "p_partkey % 9 * 8 AS C", "p_size * 8 AS W",
        "p_partkey % 60 * 4 AS H", "p_retailprice AS deadline_ms",
    )
    return tel.validate_window_config(rows).select("p_partkey", "problem")


@query(
    "kernel_params",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 60.0::DOUBLE ELSE p_retailprice END AS f0_hz,
      CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE 256 END AS n_fft, p_brand AS brand,
      p_size % 4 = 1 OR p_size % 4 = 2 AS flag FROM part""",
)
def _(spark, d):
    text = F.concat(
        F.lit("f0_hz: "),
        F.when(F.col("p_size") % 3 == 0, "none").otherwise(F.col("p_retailprice").cast("string")),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n n_fft = "), F.col("p_partkey").cast("string"))).otherwise(""),
        F.lit(", brand='"), F.col("p_brand"), F.lit("'&flag="),
        F.element_at(F.array(F.lit("off"), F.lit("YES"), F.lit("on "), F.lit("no")), F.col("p_size") % 4 + 1),
    )
    p = F.col("params")
    return tables.read(spark, d, "part").withColumn("params", text).select(
        "p_partkey",
        P.param_float(p, "f0_hz", 60.0).alias("f0_hz"),
        P.param_int(p, "n_fft", 256).alias("n_fft"),
        P.param_string(p, "brand", "none").alias("brand"),
        P.param_bool(p, "flag", False).alias("flag"),
    )


# ----------------------------------------------------------------- statistics


def _stats_sql(col: str, n: str = "") -> str:
    return ", ".join(
        [
            r(f"avg({col})", "latency_us_mean"), r(f"min({col})", "latency_us_min"), r(f"max({col})", "latency_us_max"),
            r(f"stddev_samp({col})", "latency_us_std"), f"count({col}) AS sample_count",
            r(f"quantile_cont({col}, 0.5)", "latency_us_median"), r(f"quantile_cont({col}, 0.95)", "latency_us_p95"),
            r(f"quantile_cont({col}, 0.99)", "latency_us_p99"),
        ]
    )


LATENCY_STATS_SQL = f"WITH {F1} SELECT plugin, {_stats_sql('kernel_latency_us')} FROM warm GROUP BY plugin"


@query("latency_stats", LATENCY_STATS_SQL)
def latency_stats(spark, d):
    return rounded(stats.latency_stats(derived(spark, d), "kernel_latency_us"))


@query(
    "latency_stats_tiers",
    f"""WITH {F1}, tiers AS (SELECT plugin, 'kernel' AS tier, kernel_latency_us AS v FROM warm UNION ALL
      SELECT plugin, 'adapter', adapter_latency_us FROM warm UNION ALL SELECT plugin, 'end_to_end', latency_us FROM warm)
    SELECT tier, plugin, {_stats_sql('v')} FROM tiers GROUP BY ALL""",
)
def _(spark, d):
    return rounded(stats.latency_stats_tiers(derived(spark, d)))


@query(
    "bulk_latency_stats",
    f"""WITH b AS (SELECT l_returnflag || l_linestatus AS plugin, l_extendedprice AS v FROM lineitem WHERE l_quantity >= 3)
    SELECT plugin, {_stats_sql('v').replace(', 6)', ', 4)')} FROM b GROUP BY plugin""",
)
def _(spark, d):
    return rounded(stats.latency_stats(tables.bulk_telemetry(spark, d), "latency_us"), 4)


# Student quantile by its large-sample expansion in 1/(n-1), z = normal 97.5 % point.
_T975 = """(1.959963984540054::DOUBLE + 2.372271133163155::DOUBLE / nu + 2.8225/nu/nu + 2.5558/nu/nu/nu)"""


@query(
    "mean_ci",
    f"""WITH {F1}, s AS (SELECT plugin, avg(kernel_latency_us) AS m, stddev_samp(kernel_latency_us) AS s, count(*) AS n,
      count(*) - 1.0::DOUBLE AS nu, 1.959963984540054::DOUBLE AS z FROM warm GROUP BY plugin),
    q AS (SELECT *, (z + (z**3 + z) / (4 * nu) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * nu**2)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * nu**3)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * nu**4)) * s / sqrt(n) AS half FROM s)
    SELECT plugin, n AS sample_count, {r('half', 'ci_half', 5)}, {r('m - half', 'ci_lower', 5)}, {r('m + half', 'ci_upper', 5)},
      {r('half / m * 100', 'ci_pct', 5)} FROM q""",
)
def _(spark, d):
    out = stats.mean_ci(stats.latency_stats(derived(spark, d), "kernel_latency_us"))
    return rounded(
        out.select(
            "plugin", "sample_count",
            F.col("latency_us_mean_ci_half").alias("ci_half"), F.col("latency_us_mean_ci_lower").alias("ci_lower"),
            F.col("latency_us_mean_ci_upper").alias("ci_upper"), F.col("latency_us_mean_ci_pct").alias("ci_pct"),
        ),
        5,
    )


@query(
    "deadline_miss_rate",
    f"""WITH {F1} SELECT plugin, count(*) AS total_samples, CAST(sum(deadline_missed) AS BIGINT) AS deadline_misses,
    {r('sum(deadline_missed) * 100.0::DOUBLE / count(*)', 'miss_rate')} FROM warm GROUP BY plugin""",
)
def _(spark, d):
    return rounded(stats.deadline_miss_rate(derived(spark, d)))


@query(
    "check_deadline",
    f"""WITH {F1}, m AS (SELECT plugin AS kernel, sum(deadline_missed) * 100.0::DOUBLE / count(*) AS rate, count(*) AS total_samples,
      CAST(sum(deadline_missed) AS BIGINT) AS deadline_misses FROM warm GROUP BY plugin)
    SELECT kernel, {r('rate', 'miss_rate', 4)}, total_samples, deadline_misses, 12.5::DOUBLE AS threshold,
      CASE WHEN rate <= 12.5 THEN 'PASS' ELSE 'FAIL' END AS status,
      CASE WHEN (SELECT max(rate) FROM m) <= 12.5 THEN 'PASS' ELSE 'FAIL' END AS overall FROM m""",
)
def _(spark, d):
    return rounded(stats.check_deadline(derived(spark, d), 12.5))


@query(
    "throughput_ops",
    f"WITH {F1} SELECT plugin, {r('1000000 / nullif(avg(kernel_latency_us), 0)', 'ops_per_sec', 4)} FROM warm GROUP BY plugin",
)
def _(spark, d):
    out = stats.throughput_ops(stats.latency_stats(derived(spark, d), "kernel_latency_us"))
    return rounded(out.select("plugin", "ops_per_sec"), 4)


@query(
    "harness_stats",
    f"""WITH {F1}, w AS (SELECT *, end_ts_ns - start_ts_ns AS ns, (end_ts_ns - start_ts_ns) / 1000.0::DOUBLE AS us,
        row_number() OVER (PARTITION BY plugin ORDER BY end_ts_ns - start_ts_ns, run_id, window_index) AS rn,
        count(*) OVER (PARTITION BY plugin) AS n FROM warm),
    a AS (SELECT plugin, count(*) AS windows, CAST(sum(deadline_missed) AS BIGINT) AS deadline_misses, avg(us) AS mean_us,
        stddev_pop(us) AS stddev_us, min(us) AS min_us, max(us) AS max_us,
        max(CASE WHEN rn = least(floor(n * 0.5) + 1, n) THEN us END) AS p50,
        max(CASE WHEN rn = least(floor(n * 0.95::DOUBLE) + 1, n) THEN us END) AS p95,
        max(CASE WHEN rn = least(floor(n * 0.99::DOUBLE) + 1, n) THEN us END) AS p99 FROM w GROUP BY plugin)
    SELECT plugin, windows, deadline_misses, {r('100.0::DOUBLE * deadline_misses / windows', 'miss_rate')}, {r('p50', 'p50_us')},
      {r('p95', 'p95_us')}, {r('p99', 'p99_us')}, {r('p95 - p50', 'jitter_p95_us')}, {r('p99 - p50', 'jitter_p99_us')},
      {r('min_us', 'min_us')}, {r('max_us', 'max_us')}, {r('mean_us', 'mean_us')}, {r('stddev_us', 'stddev_us')},
      2.0::DOUBLE AS windows_per_s, {r('p50 / 10240', 'p50_us_per_ch_sample')}, 0.1::DOUBLE AS deadline_ms,
      {r('p99 / 100 * 100', 'utilization_pct')} FROM a""",
)
def _(spark, d):
    return rounded(stats.harness_stats(derived(spark, d)))


@query(
    "run_metadata",
    f"""WITH {F1} SELECT {r('(max(release_ts_ns) - min(release_ts_ns)) / 1e9', 'duration_s')}, max(repeat) AS repeats,
    CAST(sum(warmup) AS BIGINT) AS warmup_windows, CAST(sum(1 - warmup) AS BIGINT) AS collected_windows FROM f1""",
)
def _(spark, d):
    return rounded(stats.run_metadata(derived(spark, d)))


@query(
    "distinct_plugins",
    f"WITH {F1} SELECT plugin, min(release_ts_ns) AS first_release_ns FROM f1 GROUP BY plugin ORDER BY 2",
)
def _(spark, d):
    out = stats.distinct_plugins(derived(spark, d)).select("plugin", F.col("first_seen.release_ts_ns").alias("first_release_ns"))
    return out.orderBy("first_release_ns")


@query(
    "latency_histogram",
    f"""WITH {F1}, w AS (SELECT plugin, (end_ts_ns - start_ts_ns) / 1000.0::DOUBLE AS us,
        row_number() OVER (PARTITION BY plugin ORDER BY end_ts_ns - start_ts_ns, run_id, window_index) AS rn,
        count(*) OVER (PARTITION BY plugin) AS n FROM warm),
    e AS (SELECT plugin, min(us) AS lo, max(us) AS hi, max(CASE WHEN rn = least(floor(n * 0.99::DOUBLE) + 1, n) THEN us END) AS p99
        FROM w GROUP BY plugin HAVING min(us) < max(us)),
    b AS (SELECT plugin, CAST(CASE WHEN p99 <= lo THEN least(floor((us - lo) / (hi - lo) * 20), 19)
        WHEN us <= p99 THEN least(floor((us - lo) / (p99 - lo) * 15), 14)
        ELSE least(15 + floor((us - p99) / (hi - p99) * 5), 19) END AS INTEGER) AS bin, count(*) AS n
        FROM w JOIN e USING (plugin) GROUP BY ALL),
    g AS (SELECT plugin, CAST(unnest(range(20)) AS INTEGER) AS bin FROM e)
    SELECT plugin, bin, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (plugin, bin)""",
)
def _(spark, d):
    return stats.latency_histogram(derived(spark, d))


@query(
    "chain_stats",
    f"""WITH {F2}, s AS (SELECT stage_index, avg(latency_us) AS m, arg_min(plugin, struct_pack(run_id, window_index)) AS kernel,
      quantile_cont(latency_us, 0.5) AS q50, quantile_cont(latency_us, 0.95) AS q95, quantile_cont(latency_us, 0.99) AS q99
      FROM chained GROUP BY stage_index)
    SELECT CAST(stage_index AS BIGINT) AS stage_index, kernel, {r('m', 'latency_us_mean')}, {r('q50', 'latency_us_median')},
      {r('q95', 'latency_us_p95')}, {r('q99', 'latency_us_p99')}, {r('m / (SELECT sum(m) FROM s) * 100', 'pct_contribution')} FROM s""",
)
def _(spark, d):
    return rounded(stats.chain_stats(chained(spark, d)))


@query(
    "chain_e2e",
    f"""WITH {F2}, w AS (SELECT window_index, sum(latency_us) AS e2e FROM chained GROUP BY ALL
      HAVING count(DISTINCT stage_index) = (SELECT count(DISTINCT stage_index) FROM chained))
    SELECT count(*) AS complete_windows, {r('coalesce(avg(e2e), 0)', 'e2e_mean')}, {r('coalesce(quantile_cont(e2e, 0.5), 0)', 'e2e_p50')},
      {r('coalesce(quantile_cont(e2e, 0.95), 0)', 'e2e_p95')}, {r('coalesce(quantile_cont(e2e, 0.99), 0)', 'e2e_p99')} FROM w""",
)
def _(spark, d):
    # one recorder wrote all stages of this table, so its rows form one run
    return rounded(stats.chain_e2e(chained(spark, d).withColumn("run_id", F.lit("base"))))


@query("distinct_stage_count", f"WITH {F2} SELECT count(DISTINCT stage_index) AS stages FROM chained")
def _(spark, d):
    return stats.distinct_stage_count(chained(spark, d))


GEO = """m AS (SELECT run_id, plugin, quantile_cont(latency_us, 0.5) AS med FROM warm GROUP BY ALL),
    g AS (SELECT run_id, exp(avg(ln(med))) AS geo FROM m GROUP BY run_id)"""


@query("geo_mean_median", f"WITH {F1}, {GEO} SELECT run_id, {r('geo', 'geo_mean_us')} FROM g")
def _(spark, d):
    return rounded(stats.geo_mean_median(derived(spark, d)))


@query(
    "condition_ratio",
    f"""WITH {F1}, {GEO} SELECT run_id, {r('geo', 'geo_mean_us')}, {r("(SELECT geo FROM g WHERE run_id = 'base')", 'baseline_us')},
    {r("geo / (SELECT geo FROM g WHERE run_id = 'base')", 'ratio')} FROM g""",
)
def _(spark, d):
    return rounded(stats.condition_ratio(derived(spark, d), "base"))


@query(
    "overhead_decomposition",
    f"""WITH {F1}, c AS (SELECT run_id, min(latency_us) AS lo, quantile_cont(latency_us, 0.5) AS med FROM warm
      WHERE plugin = 'noop' GROUP BY run_id)
    SELECT run_id, {r('lo', 'min_us')}, {r('med', 'median_us')}, {r('(SELECT min(lo) FROM c)', 'overhead_floor_us')},
      {r('med - lo', 'penalty_us')} FROM c""",
)
def _(spark, d):
    return rounded(stats.overhead_decomposition(derived(spark, d).where("plugin = 'noop'")))


@query(
    "percentile_profile",
    f"""WITH {F1} SELECT run_id, plugin, count(latency_us) AS n, {r('min(latency_us)', 'min_us')}, {r('max(latency_us)', 'max_us')},
    {r('avg(latency_us)', 'mean_us')}, {r('stddev_pop(latency_us)', 'std_us')}, {r('quantile_cont(latency_us, 0.5)', 'p50_us')},
    {r('quantile_cont(latency_us, 0.95)', 'p95_us')}, {r('quantile_cont(latency_us, 0.99)', 'p99_us')} FROM warm GROUP BY ALL""",
)
def _(spark, d):
    return rounded(stats.percentile_profile(derived(spark, d), ["run_id", "plugin"]))


@query(
    "snr_table",
    f"""WITH {F1}, nz AS (SELECT nullif(min(latency_us), 0) AS noise, min(latency_us) AS o FROM warm WHERE plugin = 'noop'),
    k AS (SELECT plugin, min(latency_us) AS lo, max(latency_us) AS hi FROM warm WHERE plugin <> 'noop' GROUP BY plugin)
    SELECT plugin, {r('lo', 'min_us')}, {r('hi', 'max_us')}, {r('o', 'overhead_us')}, {r('lo / noise', 'snr_worst')}, {r('hi / noise', 'snr_best')},
      CASE WHEN lo / noise >= 10 THEN 'exceeds' WHEN lo / noise >= 8 THEN 'borderline' ELSE 'below' END AS status FROM k, nz""",
)
def _(spark, d):
    return rounded(stats.snr_table(derived(spark, d)))


def _sizes(spark, d):
    return tables.read(spark, d, "part").selectExpr(
        "p_partkey", "(p_partkey + 1) * 8 AS channels", "(p_partkey + 1) * 8 * 9600 * 4 / 1048576D AS file_size_mb",
        "9600L AS samples", "p_size > 2 AS success",
    )


@query(
    "scaling_linearity",
    f"""WITH s AS (SELECT (p_partkey + 1) * 8 AS ch, (p_partkey + 1) * 8 * 9600 * 4 / 1048576.0::DOUBLE AS mb, p_size > 2 AS ok FROM part)
    SELECT count(*) AS runs, {r('max(ch)::DOUBLE / min(ch)', 'channel_factor')}, {r('arg_max(mb, ch) / arg_min(mb, ch)', 'size_factor')},
      {r('count(*) FILTER (ok) * 100.0::DOUBLE / count(*)', 'success_rate')},
      {r('arg_max(mb, ch) / arg_min(mb, ch) / (max(ch)::DOUBLE / min(ch)) * 100', 'linearity_pct')}, true AS is_linear FROM s""",
)
def _(spark, d):
    return rounded(stats.scaling_linearity(_sizes(spark, d)))


@query("bytes_per_channel_sample", "SELECT p_partkey, 4.0::DOUBLE AS bytes_per_channel_sample FROM part")
def _(spark, d):
    out = stats.bytes_per_channel_sample(_sizes(spark, d))
    return rounded(out.select("p_partkey", "bytes_per_channel_sample"))


@query(
    "any_signal_flags",
    f"""WITH {F1} SELECT sum(pmu_cycle_count) > 0 AS has_pmu, sum(pmu_backend_stall_cycles) > 0 AS has_stall,
    sum(osnoise_total_ns) > 0 AS has_osnoise, sum(freq_mhz) > 0 AS has_freq FROM warm""",
)
def _(spark, d):
    return stats.any_signal_flags(derived(spark, d))


# --------------------------------------------------------------------- series


@query(
    "freq_transitions",
    f"""WITH {F1}, l AS (SELECT *, lag(freq_mhz) OVER w AS f0, lag(latency_us) OVER w AS l0 FROM warm WHERE freq_mhz > 0
      WINDOW w AS (PARTITION BY run_id, plugin ORDER BY window_index))
    SELECT {KEY}, CAST(trunc(f0) AS INTEGER) AS freq_before_mhz, CAST(trunc(freq_mhz) AS INTEGER) AS freq_after_mhz,
      {r('l0', 'latency_before_us')}, {r('latency_us', 'latency_after_us')}, {r('latency_us - l0', 'latency_delta_us')}
    FROM l WHERE freq_mhz <> f0""",
)
def _(spark, d):
    return rounded(series.freq_transitions(derived(spark, d, True)))


@query(
    "latency_ecdf",
    f"""WITH {F1} SELECT plugin, {r('latency_us', 'value')}, rn AS rank, {r('rn::DOUBLE / n', 'cdf')} FROM (
      SELECT plugin, latency_us, row_number() OVER (PARTITION BY plugin ORDER BY latency_us) AS rn,
      count(*) OVER (PARTITION BY plugin) AS n FROM warm)""",
)
def _(spark, d):
    return rounded(series.latency_ecdf(derived(spark, d)))


@query(
    "ecdf_compare",
    f"""WITH {F1} SELECT CASE run_id WHEN 'base' THEN 'baseline' ELSE 'candidate' END AS side, plugin, {r('latency_us', 'value')},
      rn AS rank, {r('rn::DOUBLE / n', 'cdf')} FROM (
      SELECT run_id, plugin, latency_us, row_number() OVER (PARTITION BY run_id, plugin ORDER BY latency_us) AS rn,
      count(*) OVER (PARTITION BY run_id, plugin) AS n FROM warm)""",
)
def _(spark, d):
    return rounded(series.ecdf_compare(*runs(spark, d)))


@query(
    "platform_timeline",
    f"""WITH {F1}, p AS (SELECT * FROM warm WHERE freq_mhz > 0), k AS (SELECT plugin FROM p ORDER BY release_ts_ns, window_index, plugin LIMIT 1)
    SELECT a.run_id, a.plugin, a.window_index, {r('a.latency_us', 'latency_us')}, {r('b.freq_mhz', 'platform_freq_mhz')}
    FROM p a LEFT JOIN (SELECT * FROM p WHERE plugin = (SELECT plugin FROM k)) b USING (run_id, window_index)""",
)
def _(spark, d):
    return rounded(series.platform_timeline(derived(spark, d, True)))


@query(
    "freq_latency_points",
    f"WITH {F1} SELECT plugin, {r('freq_mhz', 'freq_mhz')}, {r('latency_us', 'latency_us')} FROM warm WHERE freq_mhz > 0",
)
def _(spark, d):
    return rounded(series.freq_latency_points(derived(spark, d)))


@query("all_runs", f"WITH {F1} SELECT run_id, max(release_ts_ns) AS last_release_ns FROM f1 GROUP BY run_id ORDER BY 2 DESC")
def _(spark, d):
    return series.all_runs(derived(spark, d))


@query("latest_run", f"WITH {F1} SELECT arg_max(run_id, release_ts_ns) AS run_id FROM f1")
def _(spark, d):
    return series.latest_run(derived(spark, d))


@query(
    "common_kernels",
    f"""WITH {F1} SELECT plugin FROM warm WHERE run_id = 'base' INTERSECT SELECT plugin FROM warm WHERE run_id = 'cand' ORDER BY 1""",
)
def _(spark, d):
    return series.common_kernels(*runs(spark, d))


@query(
    "concat_runs",
    f"""WITH {F1} SELECT run_id, plugin, count(*) AS n, count(CASE WHEN run_id = 'base' THEN freq_mhz END) AS with_freq FROM f1d GROUP BY ALL""",
)
def _(spark, d):
    base, cand = runs(spark, d)
    both = series.concat_runs(base, cand.drop("freq_mhz"))
    return both.groupBy("run_id", "plugin").agg(F.count("*").alias("n"), F.count("freq_mhz").alias("with_freq"))


@query(
    "filtered_slice",
    f"""WITH {F1} SELECT {KEY}, release_ts_ns FROM f1 WHERE plugin = 'noop'
    QUALIFY row_number() OVER (ORDER BY release_ts_ns) BETWEEN 101 AND 150""",
)
def _(spark, d):
    out = series.filtered_slice(tables.telemetry(spark, d), 100, 150, plugin="noop")
    return out.select("run_id", "plugin", "window_index", "release_ts_ns")
