"""Times headline queries on the tables in $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "latency_stats",
    "latency_stats_tiers",
    "bulk_latency_stats",
    "harness_stats",
    "latency_histogram",
    "chain_e2e",
    "freq_transitions",
    "latency_ecdf",
    "compare_runs",
    "cohort_compare",
    "shapley_r2",
    "decompose_run",
    "sliding_windows",
    "car",
    "fir_bandpass",
    "notch_iir",
    "goertzel_bandpower",
    "fft_magsq",
    "welch_psd",
    "csp_apply",
    "ica_apply",
    "fir_bandpass_q15",
    "notch_iir_q15",
    "goertzel_q15",
    "covariance",
    "csp_calibrate",
    "fastica_calibrate",
    "kernel_chain",
    "read_telemetry_ndjson",
    "stream_fir",
]


SAMPLES = int(os.environ.get("BENCH_SAMPLES", 1_000_000))
W, H = 160, 80


def throughput(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Windows per second of signal operators over a long recording read from float32 files (written once, not timed)."""
    from wavetally.operators import filters, spectral
    from wavetally.operators.windows import cyclic_replay
    from wavetally.sources.recording import RecordingFiles, write_float32
    from wavetally.testbed.signal_queries import sig

    recording = sig(spark, sf_dir)
    cycles = -(-SAMPLES // recording.count())
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        write_float32(cyclic_replay(recording, H, cycles), folder)
        files = RecordingFiles(spark, folder, 64, split_bytes=8 << 20)
        windows = (files.samples().count() - W) // H + 1
        runs = {
            "fir_bandpass": lambda: filters.fir_bandpass(files),
            "goertzel_bandpower": lambda: spectral.goertzel_bandpower(files, W, H),
            "fft_magsq": lambda: spectral.fft_magsq(files, W, H),
            "welch_psd": lambda: spectral.welch_psd(files, W, H),
        }
        out = {}
        for name, run in runs.items():
            started = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            out[name] = round(windows / (time.perf_counter() - started), 1)
        return out
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wavetally.testbed.catalog import QUERIES

    # start the JVM paths and the Python workers before the clock runs
    for name in ("deadline_miss_rate", "fir_bandpass"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    rates = throughput(spark, sf_dir)
    tables = f"{sf_dir}/embeddings.parquet"
    samples = spark.read.parquet(tables).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "signal_samples": samples,
                "throughput_samples": SAMPLES,
                "windows_per_s": rates,
                "windows_per_s_per_core": {k: round(v / int(cpus), 1) for k, v in rates.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
