"""Files, reports, chains and whole analyses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wavetally.operators import attribution as att
from wavetally.operators import compare, filters, stats, windows
from wavetally.operators import telemetry as tel
from wavetally.plans import analysis, chain, reports
from wavetally.session import scratch_path
from wavetally.sources import bench_logs, recording, telemetry_files
from wavetally.testbed import tables
from wavetally.testbed.comparison_queries import COHORTS, COMPARE, GRID, RATIO
from wavetally.testbed.registry import query, r, rounded
from wavetally.testbed.signal_queries import CLEAN, FIR, H, TAPS, W, bandpower_sql, flat, notch_sql, sig, win_sql
from wavetally.testbed.tables import F1, F2, F3
from wavetally.testbed.telemetry_queries import LATENCY_STATS_SQL, _stats_sql, chained, derived, runs

# ------------------------------------------------------------------ recordings


@query("read_float32", f"WITH {F3} SELECT 'r0' AS recording_id, t, CAST(ch AS INTEGER) AS ch, {r('v', 'v')} FROM sig")
def _(spark, d):
    path = scratch_path(spark, "recording")
    recording.write_float32(sig(spark, d), path)
    # small ranges, so that one file is read by several tasks
    back = recording.read_float32(spark, path, 64, split_bytes=64 * 4 * 50)
    return rounded(windows.long_form(back))


@query("write_float32", f"WITH {F3} SELECT count(*) * 4 AS bytes FROM sig")
def _(spark, d):
    path = scratch_path(spark, "recording")
    recording.write_float32(sig(spark, d), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length").alias("bytes"))


@query(
    "recording_files_fir",
    f"""WITH {F3}, f32 AS (SELECT t, ch, CAST(v AS FLOAT)::DOUBLE AS v FROM sig), {TAPS}, {FIR.replace('FROM clean s', 'FROM f32 s')}
    SELECT t, CAST(ch AS INTEGER) AS ch, {r('v', 'v')} FROM fir""",
)
def _(spark, d):
    path = scratch_path(spark, "recording")
    recording.write_float32(sig(spark, d), path)
    files = recording.RecordingFiles(spark, path, 64, split_bytes=64 * 4 * 100)
    return flat(filters.fir_bandpass(files))


@query(
    "recording_files_chain",
    f"""WITH {F3}, m AS (SELECT t, avg(v) AS m FROM sig GROUP BY t), car AS (SELECT t, ch, v - m AS v FROM sig JOIN m USING (t)),
    {win_sql('car', name='cw')}, bp AS (WITH {bandpower_sql('cw')}) SELECT * FROM bp""",
)
def _(spark, d):
    path = scratch_path(spark, "recording")
    recording.write_float32(sig(spark, d), path)
    files = recording.RecordingFiles(spark, path, 64, split_bytes=64 * 4 * 100)
    return flat(chain.kernel_chain(files, [chain.kernel("car"), chain.kernel("goertzel")], W, H, length=240))


# ------------------------------------------------------------------- telemetry

ROWS = """SELECT run_id, plugin, window_index, end_ts_ns, deadline_missed, stage_index, pmu_cycle_count FROM f1"""
ROW_COLS = ["run_id", "plugin", "window_index", "end_ts_ns", "deadline_missed", "stage_index", "pmu_cycle_count"]


def system_info(rows):
    """One metadata row per kernel; kernels with even name length run remotely."""
    remote = F.length("plugin") % 2 == 0
    return rows.select("plugin").distinct().select(
        "plugin",
        F.lit("system_info").alias("_type"),
        F.concat(F.lit("host-"), "plugin").alias("device_hostname"),
        F.when(remote, "board").otherwise("desk").alias("device_cpu"),
        F.lit("linux").alias("device_os"),
        F.lit("linux").alias("os"),
        F.lit("desk").alias("cpu"),
    )


def written_ndjson(spark, d):
    path = scratch_path(spark, "telemetry")
    rows = tables.telemetry(spark, d)
    telemetry_files.write_telemetry_ndjson(rows.unionByName(system_info(rows), allowMissingColumns=True), path)
    return path


@query("read_telemetry_ndjson", f"WITH {F1} {ROWS}")
def _(spark, d):
    return telemetry_files.read_telemetry_ndjson(spark, written_ndjson(spark, d)).select(*ROW_COLS)


@query("write_telemetry_ndjson", LATENCY_STATS_SQL)
def _(spark, d):
    back = telemetry_files.read_telemetry(spark, written_ndjson(spark, d))
    return rounded(stats.latency_stats(tel.derive_latency(back), "kernel_latency_us"))


def written_csv(spark, d):
    path = scratch_path(spark, "telemetry")
    telemetry_files.write_telemetry_csv(tables.telemetry(spark, d), path)
    return path


@query("read_telemetry_csv", f"WITH {F1} {ROWS}")
def _(spark, d):
    # the preferred format is absent here, so the other one is taken
    return telemetry_files.read_telemetry(spark, written_csv(spark, d), prefer="ndjson").select(*ROW_COLS)


@query(
    "write_telemetry_csv",
    f"WITH {F1} SELECT plugin, count(*) AS n, CAST(sum(end_ts_ns - start_ts_ns) AS BIGINT) AS busy_ns FROM f1 GROUP BY plugin",
)
def _(spark, d):
    back = telemetry_files.read_telemetry_csv(spark, written_csv(spark, d))
    return back.groupBy("plugin").agg(F.count("*").alias("n"), F.sum(F.col("end_ts_ns") - F.col("start_ts_ns")).alias("busy_ns"))


INFO = f"""WITH {F1}, i AS (SELECT DISTINCT plugin, length(plugin) % 2 = 0 AS remote FROM f1)"""


@query(
    "split_system_info",
    f"""{INFO} SELECT plugin, 'host-' || plugin AS device_hostname, CASE WHEN remote THEN 'board' ELSE 'desk' END AS device_cpu,
    'linux' AS device_os, 'linux' AS os, 'desk' AS cpu FROM i""",
)
def _(spark, d):
    return telemetry_files.read_system_info(spark, written_ndjson(spark, d))


@query(
    "execution_mode",
    f"""{INFO} SELECT plugin, CASE WHEN remote THEN 'Remote' ELSE 'Local' END AS execution_mode,
    CASE WHEN remote THEN 'board' ELSE 'desk' END AS shown_cpu, 'linux' AS shown_os FROM i""",
)
def _(spark, d):
    rows = tables.telemetry(spark, d, numbered=False)
    return reports.execution_mode(system_info(rows))


@query(
    "normalize_plugin",
    f"""WITH {F1} SELECT run_id, CASE WHEN event_id % 3 = 1 THEN plugin ELSE event_type END AS plugin, event_id AS window_index
    FROM f1 WHERE event_id % 7 <> 0""",
)
def _(spark, d):
    events = tables.read(spark, d, "events").select("event_id", "event_type")
    rows = tables.telemetry(spark, d, numbered=False).select("run_id", "plugin", "window_index")
    rows = rows.join(events, rows.window_index == events.event_id)
    folder = F.when(F.col("event_id") % 7 == 0, "/r/other/").otherwise("/r/kernel-data/")
    given = F.when(F.col("event_id") % 3 == 1, F.col("plugin")).when(F.col("event_id") % 3 == 2, "(unnamed)")
    rows = rows.withColumn("plugin", given).withColumn("path", F.concat(folder, "event_type", F.lit("/telemetry.ndjson")))
    return telemetry_files.normalize_plugin(rows, F.col("path")).select("run_id", "plugin", "window_index")


def written_logs(spark, d):
    """One benchmark log per supplier, written by the tasks that hold the rows."""
    root = scratch_path(spark, "bench-logs")
    rows = tables.read(spark, d, "supplier").selectExpr("(s_suppkey + 1) * 16 AS channels", "floor(abs(s_acctbal)) AS mb", "s_suppkey AS k")

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lines = ["start", f"[bench] File size: {row['mb']:.1f} MB"]
                lines += ["[bench] Generated file: x.float32"] if row["k"] % 3 else []
                lines += ["Benchmark completed"] if row["k"] % 5 else ["stopped"]
                filesystem, base = recording.file_system(root)
                filesystem.create_dir(base, recursive=True)
                with filesystem.open_output_stream(f"{base}/scalability_{row['channels']}ch.log") as f:
                    f.write("\n".join(lines).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


@query(
    "scan_bench_logs",
    """SELECT (s_suppkey + 1) * 16 AS channels, floor(abs(s_acctbal)) + 0.0::DOUBLE AS file_size_mb, s_suppkey % 3 <> 0 AS has_generation,
    s_suppkey % 5 <> 0 AS success FROM supplier""",
)
def _(spark, d):
    return bench_logs.scan_bench_logs(spark, written_logs(spark, d))


# --------------------------------------------------------------------- reports


def f2(expr: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f', round({expr}, {digits}))"


@query(
    "summary_table",
    f"""WITH {F1}, tiers AS (SELECT plugin, 'kernel' AS tier, kernel_latency_us AS v FROM warm UNION ALL
      SELECT plugin, 'adapter', adapter_latency_us FROM warm UNION ALL SELECT plugin, 'end_to_end', latency_us FROM warm)
    SELECT tier AS section, plugin AS name, concat_ws(' | ', {f2('quantile_cont(v, 0.5)')}, {f2('quantile_cont(v, 0.95)')},
      {f2('quantile_cont(v, 0.99)')}, {f2('min(v)')}, {f2('max(v)')}, {f2('stddev_samp(v)')}, count(v)) AS cells FROM tiers GROUP BY ALL
    UNION ALL SELECT 'deadline', plugin, concat_ws(' | ', count(*), CAST(sum(deadline_missed) AS BIGINT)) FROM warm GROUP BY plugin""",
)
def _(spark, d):
    table = reports.summary_table(derived(spark, d))
    # the first cell carries the interval and is checked by its own query
    return table.select("section", "name", F.concat_ws(" | ", F.slice("cells", F.lit(2), F.size("cells"))).alias("cells"))


@query("summary_lines")
def _(spark, d):
    rows = reports.summary_table(derived(spark, d)).unionByName(reports.chain_section(chained(spark, d)))
    return reports.markdown_rows(rows)


@query(
    "chain_section",
    f"""WITH {F2}, u AS (SELECT * REPLACE (latency_ns / 1003.0::DOUBLE AS latency_us) FROM chained),
    s AS (SELECT stage_index, avg(latency_us) AS m, arg_min(plugin, struct_pack(run_id, window_index)) AS kernel,
      quantile_cont(latency_us, 0.5) AS q50, quantile_cont(latency_us, 0.95) AS q95, quantile_cont(latency_us, 0.99) AS q99
      FROM u GROUP BY stage_index)
    SELECT 'chain' AS section, stage_index || ' ' || kernel AS name, concat_ws(' | ', {f2('m')}, {f2('q50')}, {f2('q95')}, {f2('q99')},
      {f2('m / (SELECT sum(m) FROM s) * 100', 1)}) AS cells FROM s""",
)
def _(spark, d):
    # a unit in which no figure lies half way between two printed ones
    rows = chained(spark, d).withColumn("latency_us", F.col("latency_ns") / 1003.0)
    table = reports.chain_section(rows).where("section = 'chain'")
    return table.select("section", "name", F.concat_ws(" | ", "cells").alias("cells"))


def unsigned_zero(expr: str, digits: int = 2) -> str:
    """A figure that rounds to zero has no sign: between equal runs that would be chance."""
    return f"printf('%.{digits}f', round({expr}, {digits}) + 0.0::DOUBLE)"


@query(
    "comparison_report",
    f"""{COMPARE} SELECT plugin AS kernel, {unsigned_zero('b50')} AS baseline_p50, {unsigned_zero('c50')} AS candidate_p50, {unsigned_zero('b95')} AS baseline_p95,
      {unsigned_zero('c95')} AS candidate_p95, {unsigned_zero('b99')} AS baseline_p99, {unsigned_zero('c99')} AS candidate_p99,
      (CASE WHEN round((c50 - b50) / b50 * 100, 2) >= 0 THEN '+' ELSE '' END) || {unsigned_zero('(c50 - b50) / b50 * 100')} AS relative_change_pct, {unsigned_zero('d', 3)} AS cohens_d,
      label AS effect_size_label, {unsigned_zero('p', 4)} AS p_value,
      CASE WHEN verdict IN ('IMPROVED', 'REGRESSED') THEN '**' || verdict || '**' ELSE verdict END AS verdict FROM v""",
)
def _(spark, d):
    out = reports.comparison_report(compare.compare_runs(*runs(spark, d), value="kernel_latency_us"))
    return out.drop("baseline", "candidate", "baseline_mean", "candidate_mean")


@query(
    "characterization_report",
    f"""WITH {F1}, {GRID}, {RATIO}, {COHORTS} SELECT plugin, {r('p50', 'typical_us', 2)}, {r('p99', 'tail_us', 2)}, n AS n_windows,
      {r('tail_ratio', 'tail_ratio', 3)}, verdict, nt AS tail_cohort_size FROM k JOIN siz USING (plugin)""",
)
def _(spark, d):
    out = reports.characterization_report(att.decompose_run(derived(spark, d)))

    def part(path: str, kind: str):
        return F.get_json_object("report", path).cast(kind)

    return out.select(
        "plugin", part("$.typical_us", "double").alias("typical_us"), part("$.tail_us", "double").alias("tail_us"),
        part("$.n_windows", "long").alias("n_windows"), part("$.tail_attribution.tail_ratio", "double").alias("tail_ratio"),
        part("$.tail_attribution.verdict", "string").alias("verdict"),
        part("$.tail_attribution.tail_cohort_size", "long").alias("tail_cohort_size"),
    )


# ---------------------------------------------------------------------- chains


@query(
    "kernel_chain",
    f"""WITH RECURSIVE {F3}, {notch_sql('sig')}, {TAPS}, {FIR.replace('FROM clean s', 'FROM notch s')},
    m AS (SELECT t, avg(v) AS m FROM fir GROUP BY t), car AS (SELECT t, ch, v - m AS v FROM fir JOIN m USING (t)), {win_sql('car')}
    SELECT window_index, i, ch, {r('v', 'v')} FROM win""",
)
def _(spark, d):
    kernels = [chain.kernel("notch_iir"), chain.kernel("bandpass_fir"), chain.kernel("car")]
    return flat(chain.kernel_chain(sig(spark, d), kernels, W, H))


@query(
    "kernel_chain_multi",
    f"""WITH {F3}, {CLEAN}, m AS (SELECT t, avg(v) AS m FROM sig GROUP BY t), car AS (SELECT t, ch, v - m AS v FROM sig JOIN m USING (t)),
    {win_sql('car', name='cw')}, {TAPS}, {FIR}, {win_sql('fir', name='fw')}, bp AS ({{}})
    SELECT 'power' AS chain, window_index, i, band, ch, v FROM bp
    UNION ALL SELECT 'clean_up', window_index, i, '', ch, {r('v', 'v')} FROM fw
    UNION ALL SELECT 'power-2', window_index, i, '', ch, {r('v', 'v')} FROM cw""".replace(
        "bp AS ({})", "bp AS (WITH " + bandpower_sql("cw") + ")"
    ),
)
def _(spark, d):
    k = chain.kernel
    whole, _status = chain.kernel_chain_multi(
        sig(spark, d),
        [("power", [k("car"), k("goertzel")]), ("clean up", [k("bandpass_fir")]), ("idle", []), ("power", [k("car")])],
        W,
        H,
    )
    return flat(whole.fillna({"band": ""}))


# Two chains in one pass, one of which raises on the windows that start above zero.
@query(
    "kernel_chains_failing",
    f"""WITH {F3}, {CLEAN}, m AS (SELECT t, avg(v) AS m FROM sig GROUP BY t), car AS MATERIALIZED (SELECT t, ch, v - m AS v FROM sig JOIN m USING (t)),
    {win_sql('car', name='cw')}, {TAPS}, {FIR}, {win_sql('fir', name='fw')}, p AS MATERIALIZED (SELECT * FROM fw),
    bad AS MATERIALIZED (SELECT window_index FROM p WHERE i = 0 AND ch = 0 AND v > 0)
    SELECT 'plain' AS chain, window_index, i, ch, {r('v', 'v')}, 0 AS window_failed, '' AS failed_kernel FROM cw
    UNION ALL SELECT 'picky', window_index, i, ch, {r('v * 2', 'v')}, 0, '' FROM p WHERE window_index NOT IN (SELECT window_index FROM bad)
    UNION ALL SELECT 'picky', window_index, 0, -1, 0, 1, 'above_zero' FROM bad""",
)
def _(spark, d):
    k = chain.kernel
    picky = chain.register_kernel("above_zero", _reject_positive_start)
    double = chain.register_kernel("double", lambda w: w * 2)
    both, _ = chain.kernel_chains(sig(spark, d), [("picky", [k("bandpass_fir"), picky, double]), ("plain", [k("car")])], W, H)
    long = both.select("chain", "window_index", "i", "window_failed", "failed_kernel", F.posexplode_outer("x").alias("ch", "v"))
    return rounded(long.fillna({"ch": -1, "v": 0.0, "failed_kernel": ""}))


def _reject_positive_start(w):
    if w[0, 0] > 0:
        raise ValueError("window starts above zero")
    return w


@query(
    "chain_shape_check",
    """WITH s AS (SELECT p_partkey // 4 AS chain_id, p_partkey % 4 AS position, nullif(p_size % 5, 0) AS in_w, nullif(p_partkey % 3, 0) AS in_c,
      nullif((p_size + p_partkey) % 5, 0) AS out_w, nullif(p_size % 3, 0) AS out_c FROM part),
    l AS (SELECT *, lag(out_w) OVER w AS have_w, lag(out_c) OVER w AS have_c FROM s WINDOW w AS (PARTITION BY chain_id ORDER BY position))
    SELECT chain_id, position, CASE WHEN have_w <> in_w THEN 'W' ELSE 'C' END AS mismatch FROM l WHERE have_w <> in_w OR have_c <> in_c""",
)
def _(spark, d):
    stages = tables.read(spark, d, "part").selectExpr(
        "p_partkey div 4 AS chain_id", "p_partkey % 4 AS position", "nullif(p_size % 5, 0) AS in_w", "nullif(p_partkey % 3, 0) AS in_c",
        "nullif((p_size + p_partkey) % 5, 0) AS out_w", "nullif(p_size % 3, 0) AS out_c",
    )
    return chain.shape_mismatches(stages).select("chain_id", "position", "mismatch")


@query(
    "register_kernel",
    f"WITH {F3}, {win_sql()} SELECT window_index, 0 AS i, ch, {r('max(v) - min(v)', 'v')} FROM win GROUP BY window_index, ch",
)
def _(spark, d):
    peak = chain.register_kernel("peak_to_peak", lambda w: np.ptp(w, axis=0, keepdims=True), lambda W, C: (1, C))
    return flat(chain.kernel_chain(sig(spark, d), [peak], W, H))


# -------------------------------------------------------------------- analyses


@query(
    "analyze_per_chain",
    f"""WITH {F1} SELECT run_id AS pipeline, plugin, {_stats_sql('kernel_latency_us')}, count(*) AS total_samples,
    CAST(sum(deadline_missed) AS BIGINT) AS deadline_misses, {r('sum(deadline_missed) * 100.0::DOUBLE / count(*)', 'miss_rate')}
    FROM warm GROUP BY run_id, plugin""",
)
def _(spark, d):
    root = scratch_path(spark, "run")
    rows = tables.telemetry(spark, d)
    for run in ("base", "cand"):
        telemetry_files.write_telemetry_ndjson(rows.where(F.col("run_id") == run), f"{root}/pipeline-{run}")
    out = analysis.analyze_per_chain(telemetry_files.read_telemetry_ndjson(spark, root))
    return rounded(out.drop(*[c for c in out.columns if "_ci_" in c]))


@query(
    "full_analysis",
    f"""WITH {F1}, l AS (SELECT freq_mhz, lag(freq_mhz) OVER (PARTITION BY run_id, plugin ORDER BY window_index) AS f0 FROM warm WHERE freq_mhz > 0)
    SELECT 'statistics' AS name, count(DISTINCT plugin) AS n FROM warm UNION ALL SELECT 'deadlines', count(DISTINCT plugin) FROM warm
    UNION ALL SELECT 'chain', 0 UNION ALL SELECT 'chain_end_to_end', 1 UNION ALL SELECT 'ecdf', count(*) FROM warm
    UNION ALL SELECT 'transitions', count(*) FROM l WHERE freq_mhz <> f0
    UNION ALL SELECT 'timeline', count(*) FROM warm WHERE freq_mhz > 0
    UNION ALL SELECT 'summary', count(DISTINCT plugin) * 4 FROM warm""",
)
def _(spark, d):
    parts = analysis.full_analysis(tables.telemetry(spark, d))
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out
