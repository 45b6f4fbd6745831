"""Running telemetry statistics from arriving files.

Counts, extremes and quantiles of event-time windows are kept as one state row per (window, kernel, cell). A cell holds
the latencies of one logarithmic step of ``CELL``, so states of a window merge by adding counts, a busy kernel is
spread over its cells, and a window holds some thousand rows however many samples it gets. When the watermark
closes a window its cells meet once, and a quantile is the middle of the cell that holds the sample of that rank: at most
``QUANTILE_ERROR`` (relative) from that sample.

A stream that ends leaves windows open, since nothing later moves the watermark. ``end_telemetry`` writes a last row
that counts nowhere but lies beyond every window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.operators.telemetry import derive_latency
from wavetally.schemas import TELEMETRY

# A cell reaches from a value to this many times that value.
CELL = 1.01
QUANTILE_ERROR = math.sqrt(CELL) - 1
# Cell of values that have no logarithm.
ZERO_CELL = -(1 << 30)
QUANTILES = {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}

# Event time of the row that ends a stream: 2200-01-01.
END_NS = 7_258_118_400_000_000_000
END_PLUGIN = "_end"


def telemetry_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """NDJSON rows below ``path/kernel-data/plugin=<kernel>/`` as they arrive."""
    reader = spark.readStream.schema(TELEMETRY)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(f"{path}/kernel-data")


def end_telemetry(spark: SparkSession, path: str) -> None:
    """Close all windows of the streams that read ``path``: no telemetry follows. Rows that still do are dropped as late."""
    names = {f.name: F.lit(None).cast(f.dataType) for f in TELEMETRY.fields}
    names |= {"plugin": F.lit(END_PLUGIN), "release_ts_ns": F.lit(END_NS), "warmup": F.lit(1)}
    last = spark.range(1).select(*[c.cast(TELEMETRY[n].dataType).alias(n) for n, c in names.items()])
    last.write.partitionBy("plugin").mode("append").json(f"{path}/kernel-data")


def _cell(v: Column) -> Column:
    """Number of the logarithmic step a value lies in; 0 and below share one."""
    return F.when(v > 0, F.floor(F.log(v) / math.log(CELL)).cast("int")).otherwise(F.lit(ZERO_CELL))


def _middle(cell: Column) -> Column:
    return F.when(cell == ZERO_CELL, F.lit(0.0)).otherwise(F.exp((cell + 0.5) * math.log(CELL)))


def _of_rank(cells: Column, total: Column, p: float) -> Column:
    """The cell that holds the ceil(p n)-th smallest of n samples; ``cells`` ascending, each with its count."""
    rank = F.greatest(F.ceil(total * F.lit(p)), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("cell"))

    def step(acc: Column, c: Column) -> Column:
        found = F.when(acc["cell"].isNull() & (acc["seen"] + c["n"] >= rank), c["cell"]).otherwise(acc["cell"])
        return F.struct((acc["seen"] + c["n"]).alias("seen"), found.alias("cell"))

    return F.aggregate(cells, start, step, lambda acc: acc["cell"])


def stream_latency_stats(
    telemetry: DataFrame, window: str = "1 second", slide: str = "500 milliseconds", delay: str = "10 seconds"
) -> DataFrame:
    """Count, mean, median, 95th and 99th percentile, extremes and misses per kernel and event-time window.

    A window is emitted once the watermark has passed its end; later rows are dropped. Quantiles are within
    ``QUANTILE_ERROR`` of the sample of that rank; missing latencies count for nothing but ``n`` and the misses."""
    rows = derive_latency(telemetry).withColumn("event_ts", F.timestamp_micros(F.floor(F.col("release_ts_ns") / 1000)))
    # the row that ends a stream is a warm-up row: it must pass the watermark, so the filter names the event time to stay behind it
    counted = F.when(F.col("event_ts").isNotNull(), F.col("warmup")) == 0
    rows = rows.withWatermark("event_ts", delay).where(counted)
    value = F.nanvl(F.col("latency_us").cast("double"), F.lit(None).cast("double"))
    cells = (
        rows.withColumn("v", value)
        .groupBy(F.window("event_ts", window, slide), "plugin", _cell(F.col("v")).alias("cell"), F.col("v").isNull().alias("missing"))
        .agg(
            F.count("*").alias("n"),
            F.sum("v").alias("total"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            F.count_if(F.coalesce(F.col("deadline_missed"), F.lit(1)) != 0).alias("misses"),
        )
    )
    whole = cells.groupBy("window", "plugin").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum(F.when(~F.col("missing"), F.col("n")).otherwise(0)).alias("valid"),
        F.min("low").alias("min_us"),
        F.max("high").alias("max_us"),
        F.sum("misses").alias("deadline_misses"),
        F.collect_list(F.when(~F.col("missing"), F.struct("cell", "n"))).alias("cells"),
    )
    held = whole.withColumn("cells", F.sort_array("cells"))
    quantiles = [_middle(_of_rank(F.col("cells"), F.col("valid"), p)).alias(a) for a, p in QUANTILES.items()]
    # the middle of the outermost cells may lie beyond the extremes
    out = held.select("*", *quantiles)
    inside = [F.least(F.greatest(F.col(a), F.col("min_us")), F.col("max_us")).alias(a) for a in QUANTILES]
    return out.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "plugin",
        "n",
        F.try_divide("total", "valid").alias("mean_us"),
        *inside,
        "min_us",
        "max_us",
        "deadline_misses",
    )
