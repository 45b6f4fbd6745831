"""Streams run over the given tables; results must equal the batch operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wavetally.operators import windows
from wavetally.operators.ordered import number_rows
from wavetally.plans import chain
from wavetally.session import materialize, scratch_path
from wavetally.sources import recording, telemetry_files
from wavetally.streaming import signal as st
from wavetally.streaming import telemetry as tst
from wavetally.streaming.recording_source import recording_stream
from wavetally.testbed import tables
from wavetally.testbed.registry import query, r, rounded
from wavetally.testbed.signal_queries import CLEAN, F3_NAN, FIR, H, LAST, SIG_OUT, TAPS, W, bandpower_sql, flat, notch_sql, sig, win_sql
from wavetally.testbed.tables import F1, F3

# Whole hops of the recording, once or repeated.
HOPS = f"hops AS (SELECT t, ch, v FROM sig WHERE t < {LAST} // {H} * {H})"


def stream(spark, d, cycles=1, nan=False):
    return st.stream_samples(sig(spark, d, nan), H, cycles, hops_per_file=2)


def kept(sql: str) -> str:
    """Every table of the text is worked out once; else each use of one repeats all before it."""
    return sql.replace(" AS (", " AS MATERIALIZED (")


def hop_windows(name: str = "win") -> str:
    return win_sql("hops", name=name).replace(LAST, "(SELECT max(t) + 1 FROM hops)")


@query(
    "stream_samples",
    f"""WITH {F3}, {HOPS}, n AS (SELECT max(t) + 1 AS n FROM hops) SELECT c * n + t AS t, CAST(ch AS INTEGER) AS ch, {r('v', 'v')}
    FROM hops, n, (SELECT unnest(range(2)) AS c)""",
)
def _(spark, d):
    return flat(st.drain(stream(spark, d, cycles=2), "samples"))


def recordings_sql(rows: str) -> str:
    """Embeddings as recordings, one per label; a sample's number is its rank there."""
    return f"""e AS (SELECT 'r' || label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding AS x
      FROM embeddings), n AS (SELECT recording_id, count(*) AS n FROM e GROUP BY recording_id), u AS (SELECT e.*, n FROM e JOIN n USING (recording_id)),
    w AS (SELECT recording_id, t, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) - 1 AS ch FROM u WHERE {rows})"""


# Recordings that grow: a query over the first half of each, stopped, and taken up again over the whole.
@query("stream_recordings", f"WITH {recordings_sql('true')} SELECT recording_id, t, CAST(ch AS INTEGER) AS ch, {r('v', 'v')} FROM w")
def _(spark, d):
    vectors = tables.read(spark, d, "embeddings").selectExpr("concat('r', label) AS recording_id", "vec_id", "embedding AS x")
    rows = number_rows(vectors, ["recording_id"], "vec_id", "t").drop("vec_id")
    rows = materialize(rows.join(rows.groupBy("recording_id").agg(F.count("*").alias("n")), "recording_id"), "recordings")
    path, out = scratch_path(spark, "growing"), scratch_path(spark, "growing-out")
    for part in ("2 * t < n", "2 * t >= n"):
        recording.write_float32(rows.where(part).select("recording_id", "t", "x"), path)
        seen = st.drain(recording_stream(spark, path, 64, split_bytes=64 << 10), "recordings", out)
    return rounded(windows.long_form(seen))


@query("stream_sliding_windows", f"WITH {F3}, {HOPS}, {hop_windows()} SELECT window_index, i, ch, {r('v', 'v')} FROM win")
def _(spark, d):
    return flat(st.drain(st.stream_sliding_windows(stream(spark, d), W, H, length=240), "windows"))


@query(
    "stream_warmup",
    f"WITH {F3}, {HOPS}, {hop_windows()} SELECT window_index, i, ch, {r('v', 'v')} FROM win WHERE window_index >= 2",
)
def _(spark, d):
    cut = st.stream_sliding_windows(stream(spark, d), W, H)
    return flat(st.drain(st.stream_warmup(cut, 1, 160, H), "windows"))


HOP_CLEAN = CLEAN.replace("FROM sig", "FROM hops")
HOP_FIR = FIR.replace(LAST, "(SELECT max(t) + 1 FROM hops)")


@query("stream_fir", f"WITH {F3_NAN}, {HOPS}, {HOP_CLEAN}, {TAPS}, {HOP_FIR} {SIG_OUT} FROM fir")
def _(spark, d):
    return flat(st.drain(st.stream_fir(stream(spark, d, nan=True), length=200), "fir"))


@query("stream_notch", f"WITH RECURSIVE {F3_NAN}, {HOPS}, {HOP_CLEAN}, {notch_sql('clean')} {SIG_OUT} FROM notch")
def _(spark, d):
    return flat(st.drain(st.stream_notch(stream(spark, d, nan=True)), "notch"))


@query(
    "stream_chain",
    f"""WITH {kept(F3)}, {kept(HOPS)}, {kept(HOP_CLEAN)}, {kept(TAPS)}, {kept(HOP_FIR)}, m AS MATERIALIZED (SELECT t, avg(v) AS m FROM fir GROUP BY t),
    car AS MATERIALIZED (SELECT t, ch, v - m AS v FROM fir JOIN m USING (t)),
    {kept(win_sql('car')).replace(LAST, '(SELECT max(t) + 1 FROM hops)')},
    bp AS MATERIALIZED (WITH {bandpower_sql('win')}), bad AS MATERIALIZED (SELECT window_index FROM win WHERE i = 0 AND ch = 0 AND v > 0)
    SELECT window_index, i, ch, v, 0 AS window_failed, -1 AS failed_stage FROM bp
    WHERE window_index NOT IN (SELECT window_index FROM bad) UNION ALL SELECT window_index, 0, -1, 0.0::DOUBLE, 1, 0 FROM bad""",
)
def _(spark, d):
    k = chain.kernel
    picky = chain.register_kernel("picky", _reject_positive_start)
    out = st.drain(st.stream_chain(stream(spark, d), [k("bandpass_fir"), k("car"), picky, k("goertzel")], W, H), "chain")
    stage = F.coalesce("failed_stage", F.lit(-1)).alias("failed_stage")
    long = out.select("window_index", "i", "window_failed", stage, F.posexplode_outer("x").alias("ch", "v"))
    return rounded(long.fillna({"ch": -1, "v": 0.0}))


def _reject_positive_start(w: np.ndarray) -> np.ndarray:
    if w[0, 0] > 0:
        raise ValueError("window starts above zero")
    return w


CELL_SQL = "CAST(floor(ln(latency_us) / ln(1.01::DOUBLE)) AS INTEGER)"


def quantile_sql(p: float) -> str:
    """Middle of the cell of the sample of that rank, between the extremes."""
    cell = f"list_sort(list({CELL_SQL}))[greatest(CAST(ceil(count(*) * {p}::DOUBLE) AS BIGINT), 1)]"
    return f"least(greatest(exp(({cell} + 0.5::DOUBLE) * ln(1.01::DOUBLE)), min(latency_us)), max(latency_us))"


@query(
    "stream_latency_stats",
    f"""WITH {F1}, b AS (SELECT *, release_ts_ns // 3600000000000 AS hr FROM warm),
    w AS (SELECT plugin, latency_us, deadline_missed, (hr - hr % 2) - 2 * unnest([0, 1]) AS s FROM b),
    g AS (SELECT s, plugin, count(*) AS n, avg(latency_us) AS m, min(latency_us) AS lo, max(latency_us) AS hi,
      {quantile_sql(0.5)} AS p50, {quantile_sql(0.95)} AS p95, {quantile_sql(0.99)} AS p99,
      CAST(sum(deadline_missed) AS BIGINT) AS deadline_misses FROM w GROUP BY s, plugin)
    SELECT plugin, s * 3600 AS window_start_s, n, {r('m', 'mean_us')}, {r('p50', 'p50_us')}, {r('p95', 'p95_us')}, {r('p99', 'p99_us')},
      {r('lo', 'min_us')}, {r('hi', 'max_us')}, deadline_misses FROM g""",
)
def _(spark, d):
    path = scratch_path(spark, "telemetry")
    telemetry_files.write_telemetry_ndjson(tables.telemetry(spark, d), path)
    tst.end_telemetry(spark, path)
    stats = tst.stream_latency_stats(tst.telemetry_stream(spark, path), "4 hours", "2 hours", "1 minute")
    out = st.drain(stats, "latency-stats")
    start = F.unix_seconds("window_start").alias("window_start_s")
    return rounded(out.select("plugin", start, "n", "mean_us", *tst.QUANTILES, "min_us", "max_us", "deadline_misses"))
