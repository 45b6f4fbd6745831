"""Domain tables derived from the given parquet tables, in Spark and in SQL.

The SQL strings are the matching common table expressions for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.operators.ordered import number_rows
from wavetally.schemas import NOT_CHAINED, TELEMETRY

RATE, LENGTH, HOP, CHANNELS = 160, 160, 80, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_telemetry(events: DataFrame, *extra: str) -> DataFrame:
    """Telemetry columns computed row by row from events."""
    rows = events.selectExpr(
        "*",
        "cast(get_json_object(props, '$.k') AS bigint) AS k",
        "unix_micros(cast(ts AS timestamp)) * 1000 AS release",
        "unix_micros(cast(ts AS timestamp)) * 1000 + cast(round(value * 1000) AS bigint) AS fin",
        "user_id % 7 = 0 OR value < 1 AS absent",
    )
    rows = rows.selectExpr(
        "*", "CASE WHEN user_id % 11 = 0 THEN 0L ELSE cast(round(value * (2000 + 10 * k)) AS bigint) END AS cycles"
    )
    return rows.selectExpr(
        "event_id",
        *extra,
        "CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'cand' END AS run_id",
        "CASE WHEN event_type = 'view' THEN 'noop' ELSE event_type END AS plugin",
        "release AS release_ts_ns",
        "release + 100000 AS deadline_ts_ns",
        "release AS start_ts_ns",
        "fin AS end_ts_ns",
        "cast(fin > release + 100000 AS int) AS deadline_missed",
        f"{LENGTH} AS W",
        f"{HOP} AS H",
        f"{CHANNELS} AS C",
        f"{RATE} AS Fs",
        "CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS warmup",
        "cast(user_id % 5 + 1 AS int) AS repeat",
        "release + 100 AS device_tin_ns",
        "CASE WHEN absent THEN 0L ELSE release + 200 END AS device_tstart_ns",
        "CASE WHEN absent THEN 0L ELSE fin - 200 END AS device_tend_ns",
        "fin - 150 AS device_tfirst_tx_ns",
        "fin - 100 AS device_tlast_tx_ns",
        "'native' AS adapter_name",
        "0 AS window_failed",
        "0 AS error_code",
        "cast(1600 + 400 * (user_id % 4) AS int) AS cpu_freq_mhz",
        "cycles AS pmu_cycle_count",
        "2 * cycles + event_id % 100 AS pmu_instruction_count",
        "cycles * (k % 50) div 100 AS pmu_backend_stall_cycles",
        "event_id * 37 % 1000 AS osnoise_total_ns",
        "1 AS dtype",
    )


def telemetry(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Kernel telemetry, one row per event, unchained.

    ``numbered=False`` leaves the window number as the event number, for
    statistics in which only the order of windows matters.
    """
    rows = _event_telemetry(read(spark, sf_dir, "events"))
    if numbered:
        rows = number_rows(rows, ["run_id", "plugin"], "event_id", "window_index")
    else:
        rows = rows.withColumn("window_index", F.col("event_id"))
    return rows.withColumn("stage_index", F.lit(NOT_CHAINED).cast("long")).select(*TELEMETRY.names)


def chain_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained telemetry: five stages, windows of 20 events, first event kept."""
    events = read(spark, sf_dir, "events")
    # stages in the alphabetical order of the event types, fixed values
    place = F.array_position(F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")]), F.col("event_type"))
    first = events.groupBy(F.floor(F.col("event_id") / 20).alias("window_index"), "event_type").agg(
        F.min_by(F.struct(*events.columns), "event_id").alias("_e")
    )
    kept = first.select("window_index", "_e.*").withColumn("stage_index", place - 1)
    return _event_telemetry(kept, "window_index", "stage_index").select(*TELEMETRY.names)


def bulk_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger latency table for throughput runs, one row per order line."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 2).cast("string").alias("run_id"),
        F.concat("l_returnflag", "l_linestatus").alias("plugin"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("window_index"),
        F.col("l_extendedprice").alias("latency_us"),
        F.when(F.col("l_quantity") < 3, 1).otherwise(0).alias("warmup"),
    )


def signal(spark: SparkSession, sf_dir: str, nan: bool = False) -> DataFrame:
    """One 64-channel recording, one row per embedding vector."""
    x = F.col("embedding").cast("array<double>")
    rows = read(spark, sf_dir, "embeddings")
    if nan:
        x = F.transform(x, lambda v, ch: F.when((F.col("vec_id") + ch) % 97 == 0, F.lit(float("nan"))).otherwise(v))
    return rows.select(F.lit("r0").alias("recording_id"), F.col("vec_id").alias("t"), x.alias("x"))


F1 = f"""
ev AS (
  SELECT event_id, user_id, value, event_type, epoch_us(ts) * 1000 AS rel,
         epoch_us(ts) * 1000 + CAST(round(value * 1000) AS BIGINT) AS fin,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
         CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'cand' END AS run_id,
         CASE WHEN event_type = 'view' THEN 'noop' ELSE event_type END AS plugin
  FROM events),
ev2 AS (
  SELECT *, (user_id % 7 = 0 OR value < 1) AS no_clock,
         CASE WHEN user_id % 11 = 0 THEN 0 ELSE CAST(round(value * (2000 + 10 * k)) AS BIGINT) END AS cyc
  FROM ev),
f1 AS (
  SELECT event_id, run_id, plugin,
         row_number() OVER (PARTITION BY run_id, plugin ORDER BY event_id) - 1 AS window_index,
         rel AS release_ts_ns, rel + 100000 AS deadline_ts_ns, rel AS start_ts_ns, fin AS end_ts_ns,
         CASE WHEN fin > rel + 100000 THEN 1 ELSE 0 END AS deadline_missed,
         {LENGTH} AS W, {HOP} AS H, {CHANNELS} AS C, {RATE} AS Fs,
         CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS warmup,
         CAST(user_id % 5 + 1 AS INTEGER) AS repeat,
         rel + 100 AS device_tin_ns,
         CASE WHEN no_clock THEN 0 ELSE rel + 200 END AS device_tstart_ns,
         CASE WHEN no_clock THEN 0 ELSE fin - 200 END AS device_tend_ns,
         fin - 150 AS device_tfirst_tx_ns, fin - 100 AS device_tlast_tx_ns,
         'native' AS adapter_name, 0 AS window_failed, 0 AS error_code,
         CAST(1600 + 400 * (user_id % 4) AS INTEGER) AS cpu_freq_mhz,
         cyc AS pmu_cycle_count, 2 * cyc + event_id % 100 AS pmu_instruction_count,
         (cyc * (k % 50)) // 100 AS pmu_backend_stall_cycles,
         (event_id * 37) % 1000 AS osnoise_total_ns,
         {NOT_CHAINED} AS stage_index, 1 AS dtype, event_type, event_id // 20 AS chain_window
  FROM ev2),
f1d AS (
  SELECT *,
         CASE WHEN device_tstart_ns > 0 THEN device_tend_ns - device_tstart_ns ELSE end_ts_ns - start_ts_ns END AS latency_ns,
         (CASE WHEN device_tstart_ns > 0 THEN device_tend_ns - device_tstart_ns ELSE end_ts_ns - start_ts_ns END) / 1000.0::DOUBLE AS latency_us,
         (device_tend_ns - device_tstart_ns) / 1000.0::DOUBLE AS kernel_latency_us,
         (device_tlast_tx_ns - device_tin_ns) / 1000.0::DOUBLE AS adapter_latency_us,
         (end_ts_ns - start_ts_ns) / 1000.0::DOUBLE AS e2e_latency_us,
         CASE WHEN pmu_cycle_count > 0 AND device_tend_ns - device_tstart_ns > 0
              THEN pmu_cycle_count::DOUBLE / (device_tend_ns - device_tstart_ns) * 1000.0::DOUBLE
              ELSE cpu_freq_mhz::DOUBLE END AS freq_mhz
  FROM f1),
warm AS (SELECT * FROM f1d WHERE warmup = 0)"""

# Chained rows: earliest event of each (window, type).
F2 = (
    F1
    + """,
f2 AS (
  SELECT * EXCLUDE (window_index, stage_index), chain_window AS window_index, stage AS stage_index FROM (
    SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS stage,
           row_number() OVER (PARTITION BY chain_window, event_type ORDER BY event_id) AS nth
    FROM f1d) WHERE nth = 1),
chained AS (SELECT * FROM f2 WHERE warmup = 0)"""
)

F3 = """
sig AS (
  SELECT vec_id AS t, generate_subscripts(embedding, 1) - 1 AS ch, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""

F3_NAN = """
sig AS (
  SELECT t, ch, CASE WHEN (t + ch) % 97 = 0 THEN 'NaN'::DOUBLE ELSE v0 END AS v FROM (
    SELECT vec_id AS t, generate_subscripts(embedding, 1) - 1 AS ch, CAST(unnest(embedding) AS DOUBLE) AS v0
    FROM embeddings))"""
