"""Run comparison and tail attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetally.operators import attribution as att
from wavetally.operators import compare
from wavetally.testbed import tables
from wavetally.testbed.registry import query, r, rounded
from wavetally.testbed.tables import F1
from wavetally.testbed.telemetry_queries import derived, runs

STEPS = 2000


def _simpson(f: str, upper: str) -> str:
    """Integral of f(x) from 0 to upper as a correlated subquery."""
    at = f"({upper} * j / {STEPS}.0::DOUBLE)"
    weight = f"CASE WHEN j IN (0, {STEPS}) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT sum({weight} * {f.format(x=at)}) FROM grid) * {upper} / {3 * STEPS}"


GRID = f"grid AS (SELECT CAST(unnest(range({STEPS + 1})) AS DOUBLE) AS j)"


def normal_p(z: str) -> str:
    return f"(1 - 2 / sqrt(2 * pi()) * {_simpson('exp(-{x} * {x} / 2)', z)})"


def t_p(t: str, nu: str) -> str:
    scale = f"exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2)) / sqrt({nu} * pi())"
    return f"greatest(1 - 2 * {scale} * {_simpson(f'exp(-({nu} + 1) / 2 * ln(1 + {{x}} * {{x}} / {nu}))', f'abs({t})')}, 0)"


def sides(value: str) -> str:
    return f"""s AS (SELECT plugin, count({value}) FILTER (run_id = 'base') AS n_a, count({value}) FILTER (run_id = 'cand') AS n_b,
      avg({value}) FILTER (run_id = 'base') AS mean_a, avg({value}) FILTER (run_id = 'cand') AS mean_b,
      var_samp({value}) FILTER (run_id = 'base') AS va, var_samp({value}) FILTER (run_id = 'cand') AS vb,
      var_pop({value}) FILTER (run_id = 'base') AS pa, var_pop({value}) FILTER (run_id = 'cand') AS pb FROM warm GROUP BY plugin),
    w AS (SELECT *, (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS t,
      (va / n_a + vb / n_b) ** 2 / ((va / n_a) ** 2 / (n_a - 1) + (vb / n_b) ** 2 / (n_b - 1)) AS dof FROM s)"""


T_OUT = f"plugin, n_a, n_b, {r('mean_a', 'mean_a')}, {r('mean_b', 'mean_b')}, {r('t', 't')}, {r('dof', 'dof', 4)}, {r('p', 'p_value')}"


@query(
    "welch_ttest",
    f"WITH {F1}, {GRID}, {sides('latency_us')}, q AS (SELECT *, {t_p('t', 'dof')} AS p FROM w) SELECT {T_OUT} FROM q",
)
def _(spark, d):
    return rounded(compare.welch_ttest(derived(spark, d), "base", "cand").withColumn("dof", F.round("dof", 4)))


@query(
    "log_welch_ttest",
    f"""WITH {F1}, {GRID}, {sides("CASE WHEN latency_us > 0 THEN ln(latency_us) END")}, q AS (SELECT *, {t_p('t', 'dof')} AS p FROM w)
    SELECT {T_OUT}, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS code FROM q""",
)
def _(spark, d):
    return rounded(compare.log_welch_ttest(derived(spark, d), "base", "cand").withColumn("dof", F.round("dof", 4)))


LABEL = "CASE WHEN abs({0}) < 0.2 THEN 'negligible' WHEN abs({0}) < 0.5 THEN 'small' WHEN abs({0}) < 0.8 THEN 'medium' ELSE 'large' END"


@query(
    "cohens_d_pop",
    f"""WITH {F1}, {sides('latency_us')}, q AS (SELECT plugin, (mean_a - mean_b) / sqrt((pa + pb) / 2) AS d FROM s)
    SELECT plugin, {r('d', 'cohens_d')}, {LABEL.format('d')} AS effect_size_label FROM q""",
)
def _(spark, d):
    return rounded(compare.cohens_d_pop(derived(spark, d), "base", "cand"))


# Half-width factor of the Student interval by its large-sample expansion.
Z = "1.959963984540054::DOUBLE"


def _t975(nu: str) -> str:
    z = Z
    return (
        f"({z} + ({z}**3 + {z}) / (4 * {nu}) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96 * ({nu})**2)"
        f" + (3 * {z}**7 + 19 * {z}**5 + 17 * {z}**3 - 15 * {z}) / (384 * ({nu})**3))"
    )


COMPARE = f"""WITH {F1}, {GRID}, {sides('kernel_latency_us')},
    m AS (SELECT plugin, run_id, quantile_cont(kernel_latency_us, 0.5) AS p50, quantile_cont(kernel_latency_us, 0.95) AS p95,
      quantile_cont(kernel_latency_us, 0.99) AS p99 FROM warm GROUP BY ALL),
    j AS (SELECT w.*, b.p50 AS b50, b.p95 AS b95, b.p99 AS b99, c.p50 AS c50, c.p95 AS c95, c.p99 AS c99,
      sqrt(va) AS sa, sqrt(vb) AS sb, (mean_b - mean_a) / sqrt((va + vb) / 2) AS d, {t_p('t', 'dof')} AS p
      FROM w JOIN m b ON b.plugin = w.plugin AND b.run_id = 'base' JOIN m c ON c.plugin = w.plugin AND c.run_id = 'cand'),
    v AS (SELECT *, {LABEL.format('d')} AS label, CASE WHEN n_a < 30 OR n_b < 30 THEN 'LOW_N' WHEN NOT p < 0.05 THEN 'NOISE'
      WHEN abs(d) < 0.2 THEN 'NEGLIGIBLE' WHEN c50 < b50 THEN 'IMPROVED' WHEN c50 > b50 THEN 'REGRESSED' ELSE 'NEGLIGIBLE' END AS verdict FROM j)"""


@query(
    "compare_runs",
    f"""{COMPARE} SELECT plugin AS kernel, {r('mean_a', 'baseline_mean')}, {r('sa', 'baseline_std')}, n_a AS baseline_n,
      {r('mean_b', 'candidate_mean')}, {r('sb', 'candidate_std')}, n_b AS candidate_n, {r('b50', 'baseline_p50')},
      {r('b95', 'baseline_p95')}, {r('b99', 'baseline_p99')}, {r('c50', 'candidate_p50')}, {r('c95', 'candidate_p95')},
      {r('c99', 'candidate_p99')}, {r('(c50 - b50) / b50 * 100', 'relative_change_pct')}, {r('d', 'cohens_d')}, {r('p', 'p_value')},
      p < 0.05 AS significant, label AS effect_size_label, verdict FROM v""",
)
def _(spark, d):
    out = compare.compare_runs(*runs(spark, d), value="kernel_latency_us")
    return rounded(out.drop("t", "dof", *[c for c in out.columns if "_ci_" in c]))


@query(
    "compare_mean_ci",
    f"""{COMPARE}, h AS (SELECT *, {_t975('(n_a - 1.0::DOUBLE)')} * sa / sqrt(n_a) AS ha, {_t975('(n_b - 1.0::DOUBLE)')} * sb / sqrt(n_b) AS hb FROM v)
    SELECT plugin AS kernel, {r('mean_a - ha', 'baseline_mean_ci_lower', 4)}, {r('mean_a + ha', 'baseline_mean_ci_upper', 4)},
      {r('mean_b - hb', 'candidate_mean_ci_lower', 4)}, {r('mean_b + hb', 'candidate_mean_ci_upper', 4)} FROM h""",
)
def _(spark, d):
    out = compare.compare_runs(*runs(spark, d), value="kernel_latency_us")
    return rounded(out.select("kernel", *[c for c in out.columns if "_ci_" in c]), 4)


@query("compare_verdict", f"{COMPARE} SELECT plugin AS kernel, label AS effect_size_label, verdict FROM v")
def _(spark, d):
    out = compare.compare_runs(*runs(spark, d), value="kernel_latency_us")
    return out.select("kernel", "effect_size_label", "verdict")


# ---------------------------------------------------------------- attribution


def covariate_rows(spark, d):
    return att.stall_covariate(derived(spark, d))


RATIO = """m AS (SELECT plugin, quantile_cont(kernel_latency_us, 0.05) AS p5, quantile_cont(kernel_latency_us, 0.5) AS p50,
      quantile_cont(kernel_latency_us, 0.99) AS p99, count(kernel_latency_us) AS n FROM warm GROUP BY plugin),
    q AS (SELECT *, CASE WHEN p50 > 0 THEN p99 / p50 ELSE 1 END AS tail_ratio FROM m),
    k AS (SELECT q.*, nz.tail_ratio AS noop_ratio, nz.p50 AS noop_p50, q.tail_ratio / nz.tail_ratio AS norm,
      CASE WHEN q.tail_ratio / nz.tail_ratio < 1.5 THEN 'platform-dominated' WHEN q.tail_ratio / nz.tail_ratio <= 3.0 THEN 'mixed'
      ELSE 'algorithmic' END AS verdict FROM q, (SELECT * FROM q WHERE plugin = 'noop') nz WHERE q.plugin <> 'noop')"""


@query(
    "tail_ratio",
    f"""WITH {F1}, {RATIO} SELECT plugin, {r('p50', 'p50')}, {r('p99', 'p99')}, {r('tail_ratio', 'tail_ratio')},
    {r('noop_ratio', 'noop_tail_ratio')}, {r('norm', 'normalized_ratio')}, verdict FROM k""",
)
def _(spark, d):
    return rounded(att.tail_ratio(derived(spark, d)))


MED = """md AS (SELECT plugin, quantile_cont(latency_us, 0.5) AS outer50, quantile_cont(latency_us - kernel_latency_us, 0.5) AS over50,
      quantile_cont(CASE WHEN pmu_cycle_count > 0 THEN pmu_instruction_count::DOUBLE / pmu_cycle_count END, 0.5) AS ipc,
      quantile_cont(CASE WHEN pmu_cycle_count > 0 AND kernel_latency_us > 0 THEN pmu_cycle_count / (kernel_latency_us * 1e-6::DOUBLE) END, 0.5) AS hz,
      quantile_cont(CASE WHEN pmu_cycle_count > 0 THEN pmu_backend_stall_cycles::DOUBLE / pmu_cycle_count END, 0.5) AS stall,
      quantile_cont(kernel_latency_us, 0.5) AS typ FROM warm GROUP BY plugin)"""


@query(
    "harness_overhead",
    f"WITH {F1}, {MED} SELECT plugin, {r('over50', 'overhead_us')}, {r('over50 / outer50 * 100', 'overhead_pct')} FROM md",
)
def _(spark, d):
    return rounded(att.harness_overhead(derived(spark, d)))


@query("pmu_ipc", f"WITH {F1}, {MED} SELECT plugin, {r('ipc', 'ipc')} FROM md")
def _(spark, d):
    return rounded(att.pmu_ipc(derived(spark, d)))


def scaled(spark, d):
    """Rows with kernel time scaled up, so that kernels pass the 50 us limit."""
    return derived(spark, d).withColumn("kernel_latency_us", F.col("kernel_latency_us") * 2)


@query(
    "effective_frequency",
    f"""WITH {F1}, s AS (SELECT * REPLACE (kernel_latency_us * 2 AS kernel_latency_us) FROM warm),
    {MED.replace('FROM warm', 'FROM s')}
    SELECT plugin, CASE WHEN typ < 50 OR hz > 1.25e9 * 1.2 THEN NULL ELSE {r('hz / 1e9', 'x').removesuffix(' AS x')} END AS effective_freq_ghz,
      CASE WHEN typ < 50 OR hz > 1.25e9 * 1.2 THEN NULL ELSE {r('(1 - hz / 1.25e9) * 100', 'x').removesuffix(' AS x')} END AS frequency_tax_pct,
      CASE WHEN typ < 50 THEN 'kernel p50 below 50 us, counter overhead dominates'
        WHEN hz > 1.25e9 * 1.2 THEN 'cycle counter uses a fixed reference clock' END AS unavailable_reason FROM md""",
)
def _(spark, d):
    return rounded(att.effective_frequency(scaled(spark, d), max_hz=1.25e9))


@query(
    "stall_split",
    f"""WITH {F1}, {MED} SELECT plugin, {r('stall * 100', 'backend_stall_pct')}, {r('typ * (1 - stall)', 'compute_time_us')},
    {r('typ * stall', 'memory_stall_time_us')} FROM md""",
)
def _(spark, d):
    return rounded(att.stall_split(derived(spark, d)))


@query(
    "characterize",
    f"""WITH {F1}, {RATIO}, {MED} SELECT plugin, {r('p5', 'best_us')}, {r('p50', 'typical_us')}, {r('p99', 'tail_us')},
      {r('greatest(p50 - p5, 0)', 'best_to_typical_gap_us')}, {r('greatest(p99 - p50, 0)', 'tail_risk_us')}, {r('noop_p50', 'noop_p50_us')},
      {r('ipc', 'ipc')}, {r('stall * 100', 'backend_stall_pct')}, {r('typ * (1 - stall)', 'compute_time_us')},
      {r('typ * stall', 'memory_stall_time_us')}, n AS n_windows, {r('tail_ratio', 'tail_ratio')}, {r('norm', 'normalized_ratio')}, verdict
    FROM k JOIN md USING (plugin)""",
)
def _(spark, d):
    out = att.characterize(derived(spark, d))
    return rounded(out.drop("_freq_reason", "_has_max", "effective_freq_ghz", "frequency_tax_pct", "noop_tail_ratio"))


@query(
    "provenance_map",
    f"""WITH {F1}, {MED}, f AS (SELECT plugin, typ < 50 AS fast FROM md WHERE plugin <> 'noop')
    SELECT plugin, unnest(['ipc', 'effective_freq_ghz', 'frequency_tax_pct', 'noop_p50_us']) AS metric,
      unnest(['measured/PMU', CASE WHEN NOT fast THEN 'measured/PMU+timing' END, NULL, 'measured/timing/noop']) AS source,
      unnest([NULL, CASE WHEN fast THEN 'kernel p50 below 50 us, counter overhead dominates' END,
        CASE WHEN fast THEN 'kernel p50 below 50 us, counter overhead dominates' ELSE 'no maximum frequency given' END, NULL]) AS reason FROM f""",
)
def _(spark, d):
    out = att.provenance_map(att.characterize(derived(spark, d)))
    names = F.array(*[F.lit(n) for n in ("ipc", "effective_freq_ghz", "frequency_tax_pct", "noop_p50_us")])
    rows = out.select("plugin", "provenance", "unavailable", F.explode(names).alias("metric"))
    return rows.select(
        "plugin", "metric", F.try_element_at("provenance", F.col("metric")).alias("source"),
        F.try_element_at("unavailable", F.col("metric")).alias("reason"),
    )


STALL = "CASE WHEN pmu_cycle_count > 0 THEN pmu_backend_stall_cycles::DOUBLE / pmu_cycle_count ELSE 0 END"


@query("stall_covariate", f"WITH {F1} SELECT run_id, plugin, release_ts_ns, {r(STALL, 'backend_stall_pct')} FROM f1d")
def _(spark, d):
    return rounded(covariate_rows(spark, d).select("run_id", "plugin", "release_ts_ns", "backend_stall_pct"))


COHORTS = f"""x AS (SELECT *, {STALL} AS stall FROM warm WHERE plugin <> 'noop'),
    lim AS (SELECT plugin, quantile_cont(kernel_latency_us, 0.25) AS p25, quantile_cont(kernel_latency_us, 0.75) AS p75,
      quantile_cont(kernel_latency_us, 0.95) AS p95 FROM x GROUP BY plugin HAVING count(*) >= 200),
    lab AS (SELECT x.*, CASE WHEN kernel_latency_us > p95 THEN 'tail' WHEN kernel_latency_us BETWEEN p25 AND p75 THEN 'typical' END AS cohort
      FROM x JOIN lim USING (plugin)),
    siz AS (SELECT plugin, count(*) FILTER (cohort = 'tail') AS nt, count(*) FILTER (cohort = 'typical') AS np FROM lab GROUP BY plugin),
    coh AS (SELECT lab.*, nt, np FROM lab JOIN siz USING (plugin) WHERE cohort IS NOT NULL AND nt >= 5 AND np >= 5)"""


@query(
    "tail_cohorts",
    f"""WITH {F1}, {COHORTS} SELECT plugin, run_id, release_ts_ns, cohort, nt AS tail_cohort_size, np AS typical_cohort_size FROM coh""",
)
def _(spark, d):
    out = att.tail_cohorts(covariate_rows(spark, d))
    return out.select("plugin", "run_id", "release_ts_ns", "cohort", "tail_cohort_size", "typical_cohort_size")


MWU = f"""lng AS (SELECT plugin, cohort, unnest(['backend_stall_pct', 'freq_mhz', 'osnoise_total_ns']) AS covariate,
      unnest([stall, freq_mhz, osnoise_total_ns::DOUBLE]) AS v FROM coh),
    rk AS (SELECT *, rank() OVER (PARTITION BY plugin, covariate ORDER BY v) + (count(*) OVER (PARTITION BY plugin, covariate, v) - 1) / 2.0::DOUBLE AS rnk,
      count(*) OVER (PARTITION BY plugin, covariate, v) AS tie FROM lng),
    ag AS (SELECT plugin, covariate, count(*) FILTER (cohort = 'tail') AS n1, count(*) FILTER (cohort = 'typical') AS n2,
      sum(rnk) FILTER (cohort = 'tail') AS r1, sum(tie::DOUBLE * tie - 1) AS ties,
      quantile_cont(v, 0.5) FILTER (cohort = 'tail') AS mt, quantile_cont(v, 0.5) FILTER (cohort = 'typical') AS mp FROM rk GROUP BY ALL),
    us AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n FROM ag),
    zs AS (SELECT *, greatest((greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM us),
    ps AS (SELECT *, greatest({normal_p('z')}, 0) AS p FROM zs)"""


@query(
    "cohort_compare",
    f"""WITH {F1}, {GRID}, {COHORTS}, {MWU} SELECT plugin, covariate, {r('mt', 'tail_median')}, {r('mp', 'typical_median')}, {r('u', 'u')},
      {r('p', 'p_value')}, p < 0.05 AS significant, CASE WHEN NOT p < 0.05 THEN 'no_difference' WHEN mt > mp THEN 'higher_in_tail'
      ELSE 'lower_in_tail' END AS direction FROM ps""",
)
def _(spark, d):
    rows = covariate_rows(spark, d)
    sizes = att.kernel_sizes(rows)
    return rounded(att.cohort_compare(att.cohort_table(rows, sizes=sizes), sizes))


@query(
    "mann_whitney_u",
    f"""WITH {F1}, {GRID}, coh AS (SELECT plugin, CASE run_id WHEN 'base' THEN 'tail' ELSE 'typical' END AS cohort, kernel_latency_us AS stall,
      freq_mhz, osnoise_total_ns FROM warm), {MWU}
    SELECT plugin, n1 AS n_first, n2 AS n_second, {r('u', 'u')}, {r('z', 'z')}, {r('p', 'p_value')} FROM ps WHERE covariate = 'backend_stall_pct'""",
)
def _(spark, d):
    rows = derived(spark, d).where("warmup = 0")
    return rounded(att.mann_whitney_u(rows, ["plugin"], "kernel_latency_us", F.col("run_id") == "base"))


# Users' events, a few against the rest: the number of ways to choose c of the first n ranks with a sum gives the exact test, which
# counts where one side has at most eight rows and nothing is tied.
SMALL_U = f"""e AS (SELECT user_id, value AS v, event_id % 11 = 0 AS f, rank() OVER (PARTITION BY user_id ORDER BY value)
      + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS rnk, count(*) OVER (PARTITION BY user_id, value) AS tie FROM events),
    ag AS (SELECT user_id, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(rnk) FILTER (f) AS r1, sum(tie::DOUBLE * tie - 1) AS ties
      FROM e GROUP BY user_id),
    us AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS n, least(n1, n2) AS m FROM ag WHERE n1 > 0 AND n2 > 0),
    zs AS (SELECT *, greatest((greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 0) AS z FROM us),
    top AS (SELECT max(n) AS top FROM us WHERE m <= 8 AND ties = 0),
    ways AS (SELECT 0::BIGINT AS n, 0::BIGINT AS c, 0::BIGINT AS s, 1.0::DOUBLE AS w
      UNION ALL SELECT n, c, s, sum(w) FROM (SELECT n + 1 AS n, c + k AS c, s + k * (n + 1) AS s, w FROM ways, top, (VALUES (0), (1)) v(k) WHERE n < top)
      WHERE c <= 8 GROUP BY ALL),
    ex AS (SELECT user_id, least(2 * sum(w) FILTER (s >= greatest(u, nn - u) + m * (m + 1) / 2) / sum(w), 1) AS p FROM zs
      JOIN ways ON ways.n = zs.n AND ways.c = zs.m WHERE m <= 8 AND ties = 0 GROUP BY user_id)"""


@query(
    "mann_whitney_small",
    f"""WITH RECURSIVE {GRID}, {SMALL_U} SELECT user_id, n1 AS n_first, n2 AS n_second, {r('u', 'u')}, {r('z', 'z')},
      {r(f"coalesce(ex.p, greatest({normal_p('z')}, 0))", 'p_value')} FROM zs LEFT JOIN ex USING (user_id)""",
)
def _(spark, d):
    rows = tables.read(spark, d, "events").select("user_id", "value", (F.col("event_id") % 11 == 0).alias("few"))
    return rounded(att.mann_whitney_u(rows, ["user_id"], "value", F.col("few")).where("n_first > 0 AND n_second > 0"))


def ks_sql(src: str, value: str, first: str) -> str:
    return f"""kv AS (SELECT plugin, {value} AS v, count(*) FILTER ({first}) AS a, count(*) FILTER (NOT {first}) AS b FROM {src} GROUP BY ALL),
    kc AS (SELECT plugin, abs(sum(a) OVER w::DOUBLE / sum(a) OVER t - sum(b) OVER w::DOUBLE / sum(b) OVER t) AS gap,
      sum(a) OVER t AS na, sum(b) OVER t AS nb FROM kv WINDOW w AS (PARTITION BY plugin ORDER BY v), t AS (PARTITION BY plugin)),
    kd AS (SELECT plugin, CAST(max(na) AS BIGINT) AS na, CAST(max(nb) AS BIGINT) AS nb, max(gap) AS d FROM kc GROUP BY plugin),
    kl AS (SELECT *, sqrt(na::DOUBLE * nb / (na + nb)) * d AS lam FROM kd),
    kr AS (SELECT plugin, na, nb, CAST(round(d * na * nb) AS BIGINT) AS h, 0::BIGINT AS s, 0::BIGINT AS i, 1.0::DOUBLE AS p, false AS gone FROM kl
      WHERE greatest(na, nb) <= 10000
      UNION ALL SELECT plugin, na, nb, h, s, i, sum(p), abs(i * nb - (s - i) * na) >= h FROM (
        SELECT plugin, na, nb, h, s + 1 AS s, i + u AS i,
          p * CASE WHEN u = 1 THEN (na - i)::DOUBLE / (na + nb - s) ELSE (nb - s + i)::DOUBLE / (na + nb - s) END AS p
        FROM kr, (VALUES (0), (1)) v(u) WHERE NOT gone AND s < na + nb) WHERE p > 0 GROUP BY ALL),
    ke AS (SELECT plugin, least(sum(p), 1) AS p FROM kr WHERE gone GROUP BY plugin),
    kp AS (SELECT * EXCLUDE (e), coalesce(e, CASE WHEN lam < 0.2 THEN 1 ELSE least(greatest(2 * (SELECT sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * (j * lam) * (j * lam)))
      FROM grid WHERE j BETWEEN 1 AND 100), 0), 1) END) AS p FROM (SELECT kl.*, ke.p AS e FROM kl LEFT JOIN ke USING (plugin)) kl)"""


@query(
    "ks_two_sample",
    f"""WITH RECURSIVE {F1}, {GRID}, {ks_sql('warm', 'latency_us', "run_id = 'base'").replace('OVER w::DOUBLE', 'OVER w')}
    SELECT plugin, na AS n_first, nb AS n_second, {r('d', 'd')}, {r('p', 'p_value')} FROM kp""",
)
def _(spark, d):
    rows = derived(spark, d).where("warmup = 0")
    return rounded(att.ks_two_sample(rows, ["plugin"], "latency_us", F.col("run_id") == "base"))


@query(
    "freq_stratification",
    f"""WITH RECURSIVE {F1}, {GRID}, x AS (SELECT * FROM warm WHERE plugin <> 'noop'),
    md AS (SELECT plugin, quantile_cont(freq_mhz, 0.5) AS f50 FROM x GROUP BY plugin HAVING count(*) >= 200),
    sp AS (SELECT plugin, kernel_latency_us AS v, abs(freq_mhz - f50) < f50 * 0.02::DOUBLE AS stable FROM x JOIN md USING (plugin)),
    sz AS (SELECT plugin, count(*) FILTER (stable) AS ns, count(*) FILTER (NOT stable) AS nu, quantile_cont(v, 0.99) FILTER (stable) AS ps99,
      quantile_cont(v, 0.99) FILTER (NOT stable) AS pu99 FROM sp GROUP BY plugin),
    {ks_sql('sp', 'v', 'stable').replace('OVER w::DOUBLE', 'OVER w')}
    SELECT plugin, ns AS stable_n, nu AS unstable_n, {r('ps99', 'stable_freq_p99_us')}, {r('pu99', 'unstable_freq_p99_us')},
      {r('d', 'ks_distance')}, {r('p', 'freq_ks_pvalue')} FROM sz JOIN kp USING (plugin) WHERE ns >= 20 AND nu >= 20""",
)
def _(spark, d):
    return rounded(att.freq_stratification(covariate_rows(spark, d)))


R2 = f"""x AS (SELECT plugin, kernel_latency_us AS y, {STALL} AS x1, 1 / (CASE WHEN freq_mhz > 0 THEN freq_mhz ELSE 1 END) AS x2,
      ln(1 + osnoise_total_ns) AS x3 FROM warm WHERE plugin <> 'noop'),
    c AS (SELECT plugin, count(*) AS n_windows, corr(y, x1) AS p, corr(y, x2) AS q, corr(y, x3) AS s, corr(x1, x2) AS a, corr(x1, x3) AS b,
      corr(x2, x3) AS g FROM x GROUP BY plugin),
    r2 AS (SELECT plugin, n_windows, p * p AS r2_1, q * q AS r2_2, s * s AS r2_3, (p * p + q * q - 2 * p * q * a) / (1 - a * a) AS r2_12,
      (p * p + s * s - 2 * p * s * b) / (1 - b * b) AS r2_13, (q * q + s * s - 2 * q * s * g) / (1 - g * g) AS r2_23,
      1 - ((1 + 2 * a * b * g - a * a - b * b - g * g) - (p * p * (1 - g * g) + q * q * (1 - b * b) + s * s * (1 - a * a)
        - 2 * p * q * (a - b * g) - 2 * p * s * (b - a * g) - 2 * q * s * (g - a * b))) / (1 + 2 * a * b * g - a * a - b * b - g * g) AS r2_123 FROM c)"""
R2_NAMES = ["r2_1", "r2_2", "r2_3", "r2_12", "r2_13", "r2_23", "r2_123"]


@query(
    "ols_r2_subsets",
    f"WITH {F1}, {R2} SELECT plugin, n_windows, {', '.join(r(n, n, 8) for n in R2_NAMES)} FROM r2",
)
def _(spark, d):
    return rounded(att.ols_r2_subsets(covariate_rows(spark, d)), 8)


SHAPLEY = f"""WITH {F1}, {R2} SELECT plugin, n_windows, {r('r2_123', 'model_r_squared')},
      {r('(r2_1 / 3 + (r2_12 - r2_2) / 6 + (r2_13 - r2_3) / 6 + (r2_123 - r2_23) / 3) * 100', 'backend_stall_pct_share')},
      {r('(r2_2 / 3 + (r2_12 - r2_1) / 6 + (r2_23 - r2_3) / 6 + (r2_123 - r2_13) / 3) * 100', 'freq_mhz_share')},
      {r('(r2_3 / 3 + (r2_13 - r2_1) / 6 + (r2_23 - r2_2) / 6 + (r2_123 - r2_12) / 3) * 100', 'osnoise_total_ns_share')},
      {r('(1 - r2_123) * 100', 'algorithmic_residual_pct')} FROM r2 WHERE n_windows >= 500"""


@query("shapley_r2", SHAPLEY)
def _(spark, d):
    return rounded(att.shapley_r2(covariate_rows(spark, d)))


@query(
    "attribution_tier",
    f"""WITH {F1}, {COHORTS}, n AS (SELECT plugin, count(*) AS n_windows FROM x GROUP BY plugin)
    SELECT plugin, n_windows, nt AS tail_cohort_size, np AS typical_cohort_size,
      CASE WHEN nt IS NULL OR nt < 5 OR np < 5 THEN 1 WHEN n_windows >= 500 THEN 3 ELSE 2 END AS tier FROM n LEFT JOIN siz USING (plugin)""",
)
def _(spark, d):
    return att.attribution_tier(covariate_rows(spark, d))


@query(
    "decompose_run",
    f"""WITH {F1}, {GRID}, {RATIO}, {COHORTS}, {MWU},
    {R2.replace('x AS (', 'rx AS (').replace('FROM x GROUP', 'FROM rx GROUP')},
    dirs AS (SELECT plugin, string_agg(CASE WHEN NOT p < 0.05 THEN 'no_difference' WHEN mt > mp THEN 'higher_in_tail' ELSE 'lower_in_tail' END, ','
      ORDER BY covariate) AS directions FROM ps GROUP BY plugin)
    SELECT plugin, n AS n_windows, {r('p50', 'typical_us')}, {r('tail_ratio', 'tail_ratio')}, verdict, nt AS tail_cohort_size, directions,
      {r('r2_123', 'model_r_squared')}, {r('(1 - r2_123) * 100', 'algorithmic_residual_pct')}, 3 AS tier
    FROM k JOIN siz USING (plugin) JOIN dirs USING (plugin) JOIN r2 USING (plugin)""",
)
def _(spark, d):
    out = att.decompose_run(derived(spark, d))
    directions = F.array_join(F.transform("covariate_comparisons", lambda c: c["direction"]), ",")
    return rounded(
        out.select(
            "plugin", "n_windows", "typical_us", "tail_ratio", "verdict", "tail_cohort_size", directions.alias("directions"),
            "model_r_squared", "algorithmic_residual_pct", "tier",
        )
    )
