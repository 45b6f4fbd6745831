"""Streamed latency statistics: bounded quantiles, every window closed, the same result in any number of batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.schemas import TELEMETRY
from wavetally.streaming import signal as st
from wavetally.streaming import telemetry as tst


def write(spark, path, rows):
    """Rows (kernel, seconds, latency in us, missed) as telemetry files."""
    frame = spark.createDataFrame(rows, "plugin string, s double, us double, deadline_missed int")
    columns = {f.name: F.lit(None).cast(f.dataType) for f in TELEMETRY.fields}
    release = (F.col("s") * 1e9).cast("long")
    columns |= {
        "plugin": F.col("plugin"), "release_ts_ns": release, "start_ts_ns": release, "warmup": F.lit(0), "deadline_missed": F.col("deadline_missed"),
        "end_ts_ns": release + (F.col("us") * 1000).cast("long"), "device_tstart_ns": F.lit(0), "device_tend_ns": F.lit(0),
    }
    frame.select(*[c.cast(TELEMETRY[n].dataType).alias(n) for n, c in columns.items()]).write.partitionBy("plugin").mode("append").json(
        f"{path}/kernel-data"
    )


@pytest.mark.parametrize("per_trigger", [None, 3])
def test_quantiles_are_within_their_bound_and_all_windows_close(spark, tmp_path, per_trigger):
    rng = np.random.default_rng(5)
    rows = [("a", float(s), float(np.round(v, 3)), int(v > 300)) for s, v in zip(rng.uniform(0, 100, 3000), rng.lognormal(5, 1.5, 3000))]
    rows += [("b", 99.5, 0.0, None), ("b", 99.6, 7.0, 0), ("c", 12.0, None, 1)]
    write(spark, str(tmp_path), rows)
    tst.end_telemetry(spark, str(tmp_path))
    stats = tst.stream_latency_stats(tst.telemetry_stream(spark, str(tmp_path), per_trigger), "20 seconds", "20 seconds", "300 seconds")
    got = {(r["plugin"], int(r["window_start"].timestamp())): r for r in st.drain(stats, "stats").collect()}
    assert sorted(got) == [*(("a", s) for s in range(0, 100, 20)), ("b", 80), ("c", 0)]
    for start in range(0, 100, 20):
        v = np.sort([us for k, s, us, _ in rows if k == "a" and start <= s < start + 20])
        row = got["a", start]
        assert row["n"] == len(v) and np.isclose(row["mean_us"], v.mean()) and row["deadline_misses"] == (v > 300).sum()
        assert (row["min_us"], row["max_us"]) == (v[0], v[-1])
        for column, p in tst.QUANTILES.items():
            exact = v[max(int(np.ceil(p * len(v))), 1) - 1]
            assert abs(row[column] / exact - 1) <= tst.QUANTILE_ERROR * (1 + 1e-9)
    b, c = got["b", 80], got["c", 0]
    assert (b["n"], b["p50_us"], b["max_us"], b["deadline_misses"]) == (2, 0.0, 7.0, 1)
    assert abs(b["p99_us"] / 7.0 - 1) <= tst.QUANTILE_ERROR
    assert (c["n"], c["mean_us"], c["p50_us"], c["deadline_misses"]) == (1, None, None, 1)


def test_windows_stay_open_without_an_end(spark, tmp_path):
    write(spark, str(tmp_path), [("a", 5.0, 1.0, 0), ("a", 65.0, 1.0, 0)])
    stats = tst.stream_latency_stats(tst.telemetry_stream(spark, str(tmp_path)), "20 seconds", "20 seconds", "10 seconds")
    assert [int(r["window_start"].timestamp()) for r in st.drain(stats, "open").collect()] == [0]


def test_a_stream_of_nothing_ends(spark, tmp_path):
    tst.end_telemetry(spark, str(tmp_path))
    assert st.drain(tst.stream_latency_stats(tst.telemetry_stream(spark, str(tmp_path))), "none").count() == 0
