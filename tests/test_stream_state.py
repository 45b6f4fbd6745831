"""State of streams: its size, its timers, what comes late."""

import time
from contextlib import contextmanager

import numpy as np
import pytest

from test_signal import make
from wavetally.operators import blocks, filters, windows
from wavetally.streaming import signal as st


def in_files(spark, path, rows, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], blocks.SIGNAL_DDL).coalesce(1).write.parquet(f"{path}/f{i:06d}")
    return st.samples_from(spark, str(path), 1)


def run(stream, path):
    """The result, and the rows of state after every batch."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out"), rows


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    """A thousand slices on one clock: only those within the slack have state; gaps at the ends of slices are settled by timers."""
    x = np.random.default_rng(3).standard_normal((4000, 2))
    gone = set(range(7, 4000, 20)) | {3, 4, 1999}  # 3, 7, 1999: last samples of their slices
    rows = [("r", t, x[t].tolist()) for t in range(4000) if t not in gone]
    signal = spark.createDataFrame(rows, blocks.SIGNAL_DDL)
    late = [("r", 5, [9.0, 9.0]), ("r", 6, [9.0, 9.0])]
    stream = in_files(spark, tmp_path / "in", [*rows[:3500], *late, *rows[3500:]], 500)
    out, state = run(st.stream_fir(stream, length=4, slack=40, clocked=True), tmp_path)
    got = {r["t"]: r["x"] for r in out.collect()}
    want = {r["t"]: r["x"] for r in filters.fir_bandpass(signal).collect()}
    assert out.count() == len(got)
    # what lies within the slack of the end is still open where a gap came before
    assert {t for t in want if t < 4000 - 40 - 8} <= got.keys() <= want.keys()
    assert all(np.allclose(got[t], want[t], atol=1e-12) for t in got)
    assert len(state) >= 8 and max(state) <= 1.2 * state[0]  # the first batch held 125 slices


def test_windows_on_one_clock(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((600, 3))
    rows = [("r", t, x[t].tolist()) for t in range(600) if t not in (100, 101, 255)] + [("r", 2000, [0.0, 0.0, 0.0])]
    stream = in_files(spark, tmp_path / "in", rows, 150)
    out, _ = run(st.stream_sliding_windows(stream, 64, 32, length=128, slack=32, fs=160.0), tmp_path)
    key = lambda df: {(r["window_index"], r["i"]): r["x"] for r in df.collect()}
    want = key(windows.sliding_windows(make(spark, x).where("t NOT IN (100, 101, 255)"), 64, 32))
    assert key(out) == want and out.count() == len(want)


def test_idle_slices_are_settled_by_a_timer(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((50, 1))
    rows = [("r", t, x[t].tolist()) for t in range(50) if t not in (20, 48)]
    stream = st.stream_filter(in_files(spark, tmp_path / "in", rows, 100), [], length=16, slack=1000, idle_ms=1500)
    writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress")
    query = writer.trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if query.exception() is not None:
                raise query.exception()
            if query.lastProgress and spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").count() >= 48:
                break
    finally:
        query.stop()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(r["t"] for r in got) == [r[1] for r in rows] and all(r["x"] == x[r["t"]].tolist() for r in got)


def test_one_kind_of_clock(spark):
    with pytest.raises(ValueError, match="not both"):
        st.Clock(10, 160.0, 100)


def test_a_recording_longer_than_the_slack_streams_whole(spark):
    """Files come in the order of time, however many tasks write them, so nothing is taken for missing."""
    n = 4 * st.SLACK
    signal = spark.range(n).selectExpr("'r' AS recording_id", "id AS t", "array(sin(id), cos(id)) AS x")
    tasks = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in tasks}
    try:
        for k, v in tasks.items():
            spark.conf.set(k, v)
        stream = st.stream_samples(signal, 256, hops_per_file=2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = st.drain(st.stream_fir(stream, length=4096), "long").select("t").collect()
    assert sorted(r.t for r in out) == list(range(n))


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches_save_changes_in_a_partition_to_a_core(spark, tmp_path):
    """Many shuffle partitions make no more tasks a batch than there are cores, and no batch saves whole stores."""
    x = np.random.default_rng(6).standard_normal((400, 2))
    stream = st.stream_fir(st.stream_samples(make(spark, x), 20), length=64)
    path = str(tmp_path / "out")
    with settings(spark, **{"spark.sql.shuffle.partitions": "64"}):
        first = st.drain(stream, "x", path)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    with settings(spark, **{"spark.sql.shuffle.partitions": "3"}):
        again = st.drain(stream, "x", path)  # nothing new; the partitions stay
    state = tmp_path / "out-progress" / "state" / "0"
    assert len([p for p in state.iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism
    batches = len(list((tmp_path / "out-progress" / "commits").glob("[0-9]*")))
    saved = [p for p in state.rglob("*.changelog") if not p.name.startswith(".")]
    assert batches >= 4 and len(saved) >= batches * spark.sparkContext.defaultParallelism
    assert first.count() == again.count() == 400


def test_replay_shuffles_once(spark):
    """Every step of the replay is one job: its rows were dealt out when the steps were laid."""
    n, steps = 64 * 30, 30
    x = np.random.default_rng(7).standard_normal((n, 2))
    signal = make(spark, x)
    spark.sparkContext.setJobGroup("replay", "")
    try:
        stream = st.stream_samples(signal, 16, hops_per_file=2, slack=128)  # two files a step
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert steps <= len(spark.sparkContext.statusTracker().getJobIdsForGroup("replay")) < 2 * steps
    rows = [r.t for r in st.drain(stream, "x").select("t").collect()]
    assert sorted(rows) == list(range(n))
