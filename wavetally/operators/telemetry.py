"""Derived columns and filters over telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.operators.ordered import number_rows, repeat_rows
from wavetally.schemas import finite_or_null, has

MHZ_PER_CYCLE_PER_NS = 1000.0


def derive_latency(df: DataFrame) -> DataFrame:
    """Add latency_ns, latency_us, kernel_latency_us, adapter_latency_us and
    e2e_latency_us where their inputs exist.

    ``latency_ns`` keeps a given value; otherwise it is the device interval
    where a device clock was recorded (> 0) and the outer interval elsewhere.
    """
    outer = F.col("end_ts_ns") - F.col("start_ts_ns") if has(df, "start_ts_ns", "end_ts_ns") else None
    device = F.col("device_tend_ns") - F.col("device_tstart_ns") if has(df, "device_tstart_ns", "device_tend_ns") else None
    derived = outer
    if device is not None:
        derived = F.when(F.col("device_tstart_ns") > 0, device)
        derived = derived if outer is None else derived.otherwise(outer)
    given = F.col("latency_ns") if has(df, "latency_ns") else None
    known = [c for c in (given, derived) if c is not None]
    if not known:
        raise ValueError("cannot derive latency: no timestamp columns")
    latency = F.coalesce(*known)
    new = {"latency_ns": latency}
    if not has(df, "latency_us"):
        new["latency_us"] = latency / 1000.0
    if device is not None:
        new["kernel_latency_us"] = device / 1000.0
    if has(df, "device_tin_ns", "device_tlast_tx_ns"):
        new["adapter_latency_us"] = (F.col("device_tlast_tx_ns") - F.col("device_tin_ns")) / 1000.0
    if outer is not None:
        new["e2e_latency_us"] = outer / 1000.0
    return df.withColumns(new)


def derive_frequency(df: DataFrame) -> DataFrame:
    """Add freq_mhz: counted cycles over device time where both are positive.

    Rows without counts take the sampled frequency; so do all rows when no row
    of the table has counts.
    """
    sampled = F.col("cpu_freq_mhz").cast("double") if has(df, "cpu_freq_mhz") else None
    if not has(df, "pmu_cycle_count", "device_tstart_ns", "device_tend_ns"):
        return df if sampled is None else df.withColumn("freq_mhz", sampled)
    wall = F.col("device_tend_ns") - F.col("device_tstart_ns")
    counted = (F.col("pmu_cycle_count") > 0) & (wall > 0)
    if sampled is None:
        fallback = F.lit(0.0)
    else:
        # with or without counts elsewhere the fallback is the same column
        fallback = sampled
    return df.withColumn(
        "freq_mhz", F.when(counted, F.col("pmu_cycle_count") / wall * MHZ_PER_CYCLE_PER_NS).otherwise(fallback)
    )


def classify_deadline(df: DataFrame) -> DataFrame:
    """Deadline = release + H/Fs seconds; missed when the end lies after it."""
    delta = F.round(F.col("H") / F.col("Fs") * 1e9).cast("long")
    known = (F.col("Fs") > 0) & (F.col("H") > 0)
    deadline = F.col("release_ts_ns") + F.when(known, delta).otherwise(F.lit(0).cast("long"))
    return df.withColumn("deadline_ts_ns", deadline).withColumn(
        "deadline_missed", (F.col("end_ts_ns") > F.col("deadline_ts_ns")).cast("int")
    )


def tag_warmup(df: DataFrame, warmup_s: int, keys: tuple[str, ...] = ("run_id", "plugin")) -> DataFrame:
    """Flag the first floor(warmup_s * Fs / H) windows of every run and kernel."""
    numbered = number_rows(df.drop("warmup"), keys, "window_index", "_nth", start=1)
    quota = F.floor(F.lit(warmup_s) * F.col("Fs") / F.col("H"))
    return numbered.withColumn("warmup", (F.col("_nth") <= quota).cast("int")).drop("_nth")


def filter_warmup(df: DataFrame, exclude_failed: bool = False) -> DataFrame:
    out = df.where(F.col("warmup") == 0)
    return out.where(F.coalesce(F.col("window_failed"), F.lit(0)) == 0) if exclude_failed else out


def filter_kernels(df: DataFrame, wanted: str, column: str = "plugin") -> DataFrame:
    """Rows of the named kernels (comma list), with their place in the list.

    Unknown names are left out, but a list of which no row has any name is an error."""
    names = [n.strip(" \t") for n in wanted.split(",")]
    names = list(dict.fromkeys(n for n in names if n))
    if not names:
        raise ValueError("kernel filter names no kernel")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int")
    kept = df.where(F.col(column).isin(names))
    if kept.select(F.lit(1)).isEmpty():
        raise ValueError(f"no kernel matches the filter: {wanted}")
    return kept.withColumn("list_position", place)


def unknown_kernels(df: DataFrame, wanted: str, column: str = "plugin") -> DataFrame:
    """Names of the list that no row carries (to be warned about)."""
    names = list(dict.fromkeys(n.strip(" \t") for n in wanted.split(",") if n.strip(" \t")))
    asked = df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return asked.join(df.select(column).distinct(), column, "left_anti")


def choose_latency_column(df: DataFrame) -> str:
    """kernel_latency_us when any warm row has it, else latency_us."""
    if not has(df, "kernel_latency_us"):
        return "latency_us"
    seen = filter_warmup(df).where(finite_or_null(F.col("kernel_latency_us")).isNotNull())
    return "latency_us" if seen.select(F.lit(1)).isEmpty() else "kernel_latency_us"


def adapter_overhead(df: DataFrame) -> DataFrame:
    """Time outside the adapter: before its input and after its last output."""
    ns = (F.col("device_tin_ns") - F.col("start_ts_ns")) + (F.col("end_ts_ns") - F.col("device_tlast_tx_ns"))
    return df.withColumn("adapter_overhead_ns", ns)


def sort_series(df: DataFrame) -> DataFrame:
    return df.orderBy("plugin", "window_index")


def labels_from_pattern(patterns: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Expand label patterns such as ``100x0,100x1`` to one label per window.

    A part that is not ``<count>x<label>`` with whole numbers >= 0 raises.
    """
    def span(part: Column) -> Column:
        good = part.rlike(r"^\s*[+]?\d+\s*x\s*[+]?\d+\s*$")
        count = F.regexp_extract(part, r"(\d+)\s*x", 1).cast("long")
        label = F.regexp_extract(part, r"x\s*[+]?(\d+)", 1).cast("int")
        bad = F.raise_error(F.concat(F.lit("bad label pattern part: "), part)).cast("long")
        return F.struct(F.when(good, count).otherwise(bad).alias("n"), label.alias("label"))

    zero = F.lit(0).cast("long")
    placed = F.transform(
        F.col("_parts"),
        lambda p, i: F.struct(
            F.aggregate(F.slice(F.col("_parts"), F.lit(1), i), zero, lambda a, q: a + q["n"]).alias("first"),
            p["n"].alias("n"),
            p["label"].alias("label"),
        ),
    )
    spans = (
        patterns.select(*keys, F.transform(F.split(F.col(column), ","), span).alias("_parts"))
        .select(*keys, F.explode(placed).alias("_s"))
        .where(F.col("_s.n") > 0)
        .select(*keys, F.col("_s.first").alias("_first"), F.col("_s.n").alias("_n"), F.col("_s.label").alias("label"))
    )
    windows = repeat_rows(spans, "_n", "_i", [*keys, "_first"])
    return windows.select(*keys, (F.col("_first") + F.col("_i") - 1).alias("window_index"), "label")


def check_label_count(labels: DataFrame, available_windows: int) -> None:
    """More labelled windows than data is an error."""
    wanted = labels.agg(F.max("window_index")).first()[0]
    if wanted is not None and wanted + 1 > available_windows:
        raise ValueError(f"{wanted + 1} labels for {available_windows} windows")


def validate_window_config(df: DataFrame) -> DataFrame:
    """Add ``problem``: why a row (Fs, C, W, H, deadline_ms) cannot be run."""
    tight = F.col("deadline_ms") < 1000.0 * F.col("H") / F.col("Fs")
    problem: Column = (
        F.when(F.col("Fs") <= 0, "Fs must be > 0")
        .when(F.col("C") <= 0, "C must be > 0")
        .when(F.col("W") <= 0, "window length must be > 0")
        .when((F.col("H") <= 0) | (F.col("H") > F.col("W")), "invalid hop/window")
        .when((F.col("deadline_ms") > 0) & tight, "deadline too tight")
    )
    return df.withColumn("problem", problem)
