"""Signals as streams: samples, filters, windows, chains.

State is kept per (recording, slice) as in the batch operators, so one recording does not live in one task, and what is
emitted equals the batch result whatever the size of the micro-batches. Samples travel as byte strings, a row per task and
slice in and out of the state, never as single rows.

Samples may arrive out of order by up to ``slack`` samples: one that has not come when a sample ``slack`` further on
has is missing, which means what it does in batch: it counts as 0, has no output, and no window holds it. How a slice ends
depends on the clock:

* ``fs`` given: recordings run on one clock, on which sample ``t`` is taken at ``t / fs`` seconds. Event time is that; the watermark
  stays ``slack`` samples behind. A timer at the end of a slice settles its last gaps and removes its state, and what comes
  later is dropped by the watermark. So state is that of the slices within ``slack``, however long a stream runs.
* ``idle_ms`` given: recordings have nothing to do with one another. What has stood still for so long is settled as it
  stands; of a finished slice a mark that drops late samples is kept for ``keep_ms`` (such a query runs until it is stopped).
* neither: a slice sees ``slack`` samples beyond its end, so that its last gaps settle too; gaps in the last ``slack`` samples of a
  recording stay open, and the marks of finished slices stay.

The state of a slice holds its progress, samples that arrived out of order, what its filters carry on, and the filtered samples of
unfinished windows, each in a variable of its own. State lies in RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavetally.operators.blocks import SIGNAL_DDL, SLICE, Stage, packed, zero_nan
from wavetally.operators.filters import decay_length, fir_stage, notch_coefficients, recursion
from wavetally.operators.windows import check_window, cyclic_replay
from wavetally.plans.chain import Kernel, chain_shape_check
from wavetally.schemas import SIGNAL
from wavetally.session import scratch_path

SLACK = 2048
KEEP_MS = 3_600_000

# Several state variables need RocksDB. With its changelog a batch saves what it changed, not the whole of every store.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PARTITIONS_KEY = "spark.sql.shuffle.partitions"


@dataclass(frozen=True)
class StreamStage:
    """A filter advanced run by run: ``step(carry, x) -> (carry, y)``.

    ``history`` is how far before a slice it has to start so that an empty
    carry there makes no difference inside.
    """

    name: str
    history: int
    step: Callable[[bytes, np.ndarray], tuple[bytes, np.ndarray]]


def stateless_step(stage: Stage) -> StreamStage:
    """Any stage by keeping its last ``history`` inputs."""
    history, block = stage.history, stage.block

    def step(carry: bytes, x: np.ndarray):
        past = np.frombuffer(carry).reshape(-1, x.shape[1]) if carry else np.zeros((0, x.shape[1]))
        both = np.concatenate([past, x])
        y = block(both)[len(past) :]
        return (both[len(both) - min(history, len(both)) :].tobytes() if history else b""), y

    return StreamStage(stage.name, history, step)


def notch_step(f0: float = 60.0, q: float = 30.0, fs: float = 160.0, design: str = "exact") -> StreamStage:
    """Notch carrying two inputs and two outputs per channel."""
    b, a = notch_coefficients(f0, q, fs, design)

    def step(carry: bytes, x: np.ndarray):
        x = zero_nan(x)
        state = np.frombuffer(carry).reshape(4, -1) if carry else np.zeros((4, x.shape[1]))
        y = recursion(x, b, a, state)
        x1, x2 = (x[-1], x[-2]) if len(x) > 1 else (x[-1], state[0])
        y1, y2 = (y[-1], y[-2]) if len(y) > 1 else (y[-1], state[2])
        return np.stack([x1, x2, y1, y2]).tobytes(), y

    return StreamStage("notch_iir", decay_length(a[1]), step)


def fir_step(fs: float = 160.0, low: float = 8.0, high: float = 30.0) -> StreamStage:
    return stateless_step(fir_stage(fs, low, high))


@dataclass(frozen=True)
class Clock:
    """How slices end; see the module's text."""

    slack: int = SLACK
    fs: float | None = None
    idle_ms: int | None = None
    keep_ms: int = KEEP_MS

    def __post_init__(self):
        if self.fs is not None and self.idle_ms is not None:
            raise ValueError("a stream has a sample clock or an idle time, not both")

    @property
    def mode(self) -> str:
        return "EventTime" if self.fs is not None else "None" if self.idle_ms is None else "ProcessingTime"

    @property
    def beyond(self) -> int:
        """Samples beyond its end that a slice must see for its last gaps to settle."""
        return 0 if self.fs is not None else self.slack

    def at(self, t: int) -> int:
        """Time of a sample in ms."""
        return int(t * 1000 / self.fs)


class _Slice(StatefulProcessor):
    """Advances the samples of one slice through filters; ``own`` turns what has been filtered into rows."""

    def __init__(self, stages: list[StreamStage], length: int, history: int, after: int, clock: Clock):
        self.stages, self.length, self.history, self.after, self.clock = stages, length, history, after, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        carried = ", ".join(f"c{i} binary" for i in range(len(self.stages))) or "none int"
        self.handle = handle
        self.progress = handle.getValueState("progress", "next long, channels int, width int, timer long")
        self.pending = handle.getValueState("pending", "t binary, x binary")
        self.carried = handle.getValueState("carried", carried)
        self.unfinished = handle.getValueState("unfinished", "x binary")
        kept = self.clock.keep_ms if self.clock.idle_ms is not None else None
        self.finished = handle.getValueState("finished", "done boolean", kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [c for pdf in rows for c in zip(pdf["t"], pdf["x"], pdf["channels"])]
        if not self.finished.exists():
            yield from self._advanced(key, chunks, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.progress.exists():
            yield from self._advanced(key, [], timerValues, True)
        if self.clock.fs is not None:
            self.finished.clear()  # nothing of this slice passes the watermark any more

    def close(self) -> None:
        pass

    def _advanced(self, key, chunks: list, timers, last: bool) -> Iterator[pd.DataFrame]:
        name, number = key[0], int(key[1])
        self._load(max(0, number * self.length - self.history))
        self._add(chunks)
        first, y, seen = self._advance(None if last else self.clock.slack)
        rows, over = self._own(name, number, first, y, seen)
        if last or over:
            for state in (self.progress, self.pending, self.carried, self.unfinished):
                state.clear()
            self.finished.update((True,))
        else:
            self._save()
        if not last:
            self._set_timer(number, timers, over)
        if rows is not None and len(rows):
            yield rows

    def _set_timer(self, number: int, timers, over: bool) -> None:
        if self.clock.fs is not None:
            self.handle.registerTimer(self.clock.at((number + 1) * self.length + self.after))
        elif self.clock.idle_ms is not None:
            if self.timer:
                self.handle.deleteTimer(self.timer)
            if not over:
                now = timers.getCurrentProcessingTimeInMs() + self.clock.idle_ms
                self.handle.registerTimer(now)
                self.progress.update((self.next, self.channels, self.width, now))

    def _load(self, start: int) -> None:
        self.next, self.channels, self.width, self.timer = start, 0, 0, 0
        self.t, self.x = np.zeros(0, dtype=np.int64), np.zeros((0, 0))
        self.carry, self.buffer = [b"" for _ in self.stages], None
        if self.progress.exists():
            self.next, self.channels, self.width, self.timer = self.progress.get()
            self.x = np.zeros((0, self.channels))
            if self.pending.exists():
                t, x = self.pending.get()
                self.t, self.x = np.frombuffer(t, dtype=np.int64), np.frombuffer(x).reshape(-1, self.channels)
            if self.stages and self.carried.exists():
                self.carry = [bytes(c) for c in self.carried.get()]
            if self.width and self.unfinished.exists():
                self.buffer = np.frombuffer(self.unfinished.get()[0]).reshape(-1, self.width)

    def _save(self) -> None:
        self.width = 0 if self.buffer is None else self.buffer.shape[1]
        self.progress.update((self.next, self.channels, self.width, self.timer or 0))
        if len(self.t):
            self.pending.update((self.t.tobytes(), np.ascontiguousarray(self.x).tobytes()))
        else:
            self.pending.clear()
        if self.stages:
            self.carried.update(tuple(self.carry))
        if self.buffer is not None:
            self.unfinished.update((np.ascontiguousarray(self.buffer).tobytes(),))

    def _add(self, chunks: list) -> None:
        """Take new samples; what lies before the progress has been dealt with and is dropped."""
        if not chunks:
            return
        widths = {int(c) for _, _, c in chunks} | ({self.channels} if self.channels else set())
        if len(widths) > 1:
            raise ValueError("the channel count changes within a recording")
        self.channels = widths.pop()
        ts = [self.t, *(np.frombuffer(t, dtype=np.int64) for t, _, _ in chunks)]
        xs = [self.x.reshape(-1, self.channels), *(np.frombuffer(x).reshape(-1, self.channels) for _, x, _ in chunks)]
        t, at = np.unique(np.concatenate(ts), return_index=True)
        keep = t >= self.next
        self.t, self.x = t[keep], np.concatenate(xs)[at][keep]

    def _advance(self, slack: int | None) -> tuple[int, np.ndarray, np.ndarray]:
        """First sample, filtered samples and which of them were there, up to the last that is settled.

        Settled is what follows on without a gap, and all that lies ``slack`` before the newest sample (None: all)."""
        first, end = self.next, self.next
        if len(self.t):
            end = max(end, int(self.t[-1]) + 1 - (slack or 0))
            rest = self.t[self.t >= end]
            end += int((rest == end + np.arange(len(rest))).cumprod().sum())
        n = int(np.searchsorted(self.t, end))
        run = np.full((end - first, self.channels), np.nan)
        seen = np.zeros(end - first, dtype=bool)
        run[self.t[:n] - first], seen[self.t[:n] - first] = self.x[:n], True
        self.t, self.x, self.next = self.t[n:], self.x[n:], end
        if len(run):
            for i, stage in enumerate(self.stages):
                self.carry[i], run = stage.step(self.carry[i], run)
        return first, run, seen


class _Filtered(_Slice):
    DDL = "recording_id string, t binary, x binary, channels int"

    def _own(self, name, number, first, y, seen):
        start = number * self.length
        t = first + np.arange(len(y))
        own = (t >= start) & (t < start + self.length) & seen
        out = None
        if own.any():
            values = np.ascontiguousarray(y[own])
            out = pd.DataFrame({"recording_id": [name], "t": [t[own].tobytes()], "x": [values.tobytes()], "channels": [y.shape[1]]})
        return out, self.next >= start + self.length


def _stateful(stream: DataFrame, processor: _Slice, ddl: str) -> DataFrame:
    """Samples packed by slice in every task, then handed to the state of their slice."""
    clock = processor.clock
    for key, value in STORE.items():
        stream.sparkSession.conf.set(key, value)
    parts = packed(stream, processor.length, processor.history, processor.after + clock.beyond)
    if clock.fs is not None:
        parts = parts.withColumn("ts", F.timestamp_micros((F.col("last_t") * (1e6 / clock.fs)).cast("long")))
        parts = parts.withWatermark("ts", f"{int(clock.slack * 1000 / clock.fs)} milliseconds")
    return parts.groupBy("recording_id", "slice").transformWithStateInPandas(processor, ddl, "append", clock.mode)


def _samples(df: DataFrame) -> DataFrame:
    """Byte strings back to a row per sample, without touching single values."""

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, t, x, channels = (c[i].as_py() for c in batch.columns)
                at, values = np.frombuffer(t, dtype=np.int64), np.frombuffer(x)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * channels)
                lists = pa.ListArray.from_arrays(offsets, pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), lists], ["recording_id", "t", "x"])

    return df.mapInArrow(unpack, SIGNAL_DDL)


def stream_filter(
    stream: DataFrame, stages: list[StreamStage], length: int = SLICE, slack: int = SLACK, idle_ms: int | None = None, fs: float | None = None
) -> DataFrame:
    """Filtered samples (recording_id, t, x), each as soon as all before it in its slice have arrived or are known to be missing."""
    clock = Clock(slack, fs, idle_ms)
    return _samples(_stateful(stream, _Filtered(stages, length, sum(s.history for s in stages), 0, clock), _Filtered.DDL))


def stream_fir(
    stream: DataFrame,
    fs: float = 160.0,
    low: float = 8.0,
    high: float = 30.0,
    length: int = SLICE,
    slack: int = SLACK,
    idle_ms: int | None = None,
    clocked: bool = False,
) -> DataFrame:
    """``clocked``: recordings run on one clock of ``fs`` samples a second."""
    return stream_filter(stream, [fir_step(fs, low, high)], length, slack, idle_ms, fs if clocked else None)


def stream_notch(
    stream: DataFrame,
    f0: float = 60.0,
    q: float = 30.0,
    fs: float = 160.0,
    length: int = SLICE,
    slack: int = SLACK,
    idle_ms: int | None = None,
    clocked: bool = False,
) -> DataFrame:
    return stream_filter(stream, [notch_step(f0, q, fs)], length, slack, idle_ms, fs if clocked else None)


CHAIN_DDL = (
    "recording_id string, window_index long, i int, x array<double>, window_failed int, failed_stage int, error string"
)


class _Cut(_Slice):
    """Full windows, passed through ``blocks``; a window whose block fails yields one row that names the stage."""

    DDL = "recording_id string, window_index long, rows int, x binary, channels int, window_failed int, failed_stage int, error string"

    def __init__(self, stages, blocks, W: int, H: int, length: int, clock: Clock):
        self.blocks, self.W, self.H, self.per_slice = blocks, W, H, max(1, length // H)
        super().__init__(stages, self.per_slice * H, sum(s.history for s in stages), max(0, W - H), clock)

    def _own(self, name, number, first, y, seen):
        lead = number * self.per_slice
        y = np.concatenate([y, seen[:, None]], axis=1)  # the last column says which samples were there
        held = y if self.buffer is None or not len(self.buffer) else np.concatenate([self.buffer, y])
        base, k, out = self.next - len(held), lead, []
        k = max(lead, -(-base // self.H))
        while k < lead + self.per_slice and k * self.H + self.W <= self.next:
            at = k * self.H - base
            if held[at : at + self.W, -1].all():
                out.append((name, k, *self._through(held[None, at : at + self.W, :-1])))
            k += 1
        self.buffer = held[max(0, k * self.H - base) :]
        names = [c.split()[0] for c in self.DDL.split(", ")]
        rows = pd.DataFrame(out, columns=names).astype({"failed_stage": "Int32"}) if out else None
        return rows, k >= lead + self.per_slice

    def _through(self, w: np.ndarray) -> tuple:
        for stage, block in enumerate(self.blocks):
            try:
                w = block(w)
            except Exception as e:  # the failure is a row of the result
                return 1, None, 0, 1, stage, str(e)
        return w.shape[1], np.ascontiguousarray(w[0]).tobytes(), w.shape[2], 0, None, None


def _windowed(stream: DataFrame, stages: list[StreamStage], blocks: list, W: int, H: int, length: int, clock: Clock) -> DataFrame:
    """Every full window once, as one packed row; then a row per window and line."""
    check_window(W, H)

    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, failed = r["rows"], r["x"] is None
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * r["channels"])
                lists = pa.nulls(1, pa.list_(pa.float64())) if failed else pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(r["x"])))
                columns = [
                    pa.array([r["recording_id"]] * n, pa.string()), pa.array([r["window_index"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                    lists, pa.array([r["window_failed"]] * n, pa.int32()), pa.array([r["failed_stage"]] * n, pa.int32()),
                    pa.array([r["error"]] * n, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["recording_id", "window_index", "i", "x", "window_failed", "failed_stage", "error"])

    return _stateful(stream, _Cut(stages, blocks, W, H, length, clock), _Cut.DDL).mapInArrow(unpack, CHAIN_DDL)


def stream_sliding_windows(
    stream: DataFrame, W: int, H: int, length: int = SLICE, slack: int = SLACK, idle_ms: int | None = None, fs: float | None = None
) -> DataFrame:
    """Every full window once, equal to the batch windows."""
    return _windowed(stream, [], [], W, H, length, Clock(slack, fs, idle_ms)).select("recording_id", "window_index", "i", "x")


def stream_warmup(windowed: DataFrame, warmup_s: float, fs: int, H: int) -> DataFrame:
    """Drop the first windows of every recording; windows carry their number,
    so no counter is kept."""
    return windowed.where(F.col("window_index") >= int(warmup_s * fs) // H)


def stream_chain(
    stream: DataFrame,
    kernels: list[Kernel],
    W: int,
    H: int,
    fs: float = 160.0,
    channels: int = 64,
    length: int = SLICE,
    slack: int = SLACK,
    idle_ms: int | None = None,
    clocked: bool = False,
) -> DataFrame:
    """A kernel chain over a stream: leading filters advance with the samples,
    the rest runs on each window; the first failing kernel ends its window."""
    chain_shape_check(kernels, W, channels)
    split = next((n for n, k in enumerate(kernels) if k.stage is None), len(kernels))
    stages = [stateless_step(k.stage) for k in kernels[:split]]
    blocks, rows, cols = [], W, channels
    for k in kernels[:split]:
        rows, cols = k.output_shape(rows, cols)
    for k in kernels[split:]:
        if k.stage is not None:
            if k.stage.history:
                raise ValueError(f"{k.name} keeps history over samples and cannot follow a window kernel")
            block = k.stage.block
            blocks.append(lambda w, b=block: b(w.reshape(-1, w.shape[2])).reshape(w.shape[0], w.shape[1], -1))
        else:
            blocks.append(k.window(rows, fs).block)
        rows, cols = k.output_shape(rows, cols)
    return _windowed(stream, stages, blocks, W, H, length, Clock(slack, fs if clocked else None, idle_ms))


def stream_samples(
    signal: DataFrame, H: int, cycles: int = 1, hops_per_file: int = 1, files_per_trigger: int = 4, slack: int = SLACK
) -> DataFrame:
    """A recording as a stream of hop-sized chunks, rewound ``cycles`` times.

    Chunks are written to the shared folder and read by a file stream; pace is
    the trigger's. A file stream reads files by their time of writing, so a long recording is written in steps of half
    of ``slack`` samples, one after another: no sample comes later than ``slack`` allows.
    """
    spark = signal.sparkSession
    path = scratch_path(spark, "sample-chunks")
    chunk = F.floor(F.col("t") / (H * hops_per_file))
    step = F.floor(F.col("chunk") / max(1, slack // 2 // (H * hops_per_file)))
    laid = scratch_path(spark, "sample-steps")
    replay = cyclic_replay(signal, H, cycles).withColumn("chunk", chunk).withColumn("step", step)
    # the one shuffle: a chunk of a recording lies in one file from here on
    replay.repartition("recording_id", "chunk").write.partitionBy("step").parquet(laid)
    steps = spark.read.schema(replay.schema).parquet(laid)
    for (n,) in steps.select("step").distinct().orderBy("step").collect():
        part = steps.where(F.col("step") == n).drop("step")
        part.write.mode("append").partitionBy("chunk").parquet(path)
    return samples_from(spark, path, files_per_trigger)


def samples_from(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    reader = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", True).parquet(path)


def drain(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over what its source holds now; the result as a table.

    With the ``path`` of an earlier run it goes on where that ended, and the table holds what both gave. Every partition
    of the state costs a task, a store and a Python worker in every batch, so there is at most one to a core, however many
    the session's batch jobs shuffle into; a query that goes on keeps those it began with."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-progress")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    session = int(spark.conf.get(PARTITIONS_KEY))
    spark.conf.set(PARTITIONS_KEY, min(session, spark.sparkContext.defaultParallelism))
    try:
        query = writer.start()  # takes the settings of this moment
    finally:
        spark.conf.set(PARTITIONS_KEY, session)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
