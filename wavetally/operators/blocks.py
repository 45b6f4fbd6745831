"""Time-sliced processing of long recordings.

A signal here is a DataFrame of samples or ``RecordingFiles``, which are read
slice by slice. A recording is cut into slices of consecutive samples. Every slice also gets
the samples just before it (filter history) or just after it (the rest of the
windows that start in it), so slices are independent: one recording of any
length is spread over as many tasks as it has slices, at the price of one
shuffle and a few copied samples. Inside a task a slice is a (samples,
channels) array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 8192

SIGNAL_DDL = "recording_id string, t long, x array<double>"


@dataclass(frozen=True)
class Stage:
    """A per-sample transform of a signal.

    ``history`` is how many earlier samples one output needs; ``block`` maps
    (samples, channels) to (samples, channels out), with silence before.
    """

    name: str
    history: int
    block: Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class WindowStage:
    """A transform of whole windows: (windows, W, C) to (windows, rows, C)."""

    name: str
    block: Callable[[np.ndarray], np.ndarray]
    bands: tuple[str, ...] = ()
    hz_per_row: float | None = None


def zero_nan(x: np.ndarray) -> np.ndarray:
    """NaN as 0; infinite samples stay infinite."""
    return np.where(np.isnan(x), 0.0, x)


def to_array(column: pa.ChunkedArray) -> np.ndarray:
    """List column to (rows, channels); missing values become NaN. All lists must have one length."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(lists)
    if lists.null_count or len(lists) and pc.min(lengths) != pc.max(lengths):
        raise ValueError("samples of different channel counts cannot form one array")
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows and samples of a batch per channel count.

    Recordings of different channel counts may share a table; within one recording the count must not change. A row
    without samples (null) is a missing row."""
    lists = batch.column(batch.schema.get_field_index("x"))
    if lists.null_count:
        batch = batch.filter(pc.is_valid(lists))
        lists = batch.column(batch.schema.get_field_index("x"))
    if batch.num_rows == 0:
        return
    widths = pc.list_value_length(lists).to_numpy()
    if (widths == widths[0]).all():
        yield batch, to_array(lists)
        return
    if "recording_id" in batch.schema.names:
        names = batch.column(batch.schema.get_field_index("recording_id")).dictionary_encode().indices.to_numpy()
        if len(np.unique(np.stack([names, widths]), axis=1).T) > len(np.unique(names)):
            raise ValueError("the channel count changes within a recording")
    for width in np.unique(widths):
        part = batch.take(pa.array(np.flatnonzero(widths == width)))
        yield part, to_array(part.column(part.schema.get_field_index("x")))


def to_lists(values: np.ndarray) -> pa.Array:
    n, c = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * c)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def sliced(signal: DataFrame, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """Assign samples to slices, copying those that neighbours need."""
    t = F.col("t")
    first = F.floor((t - after) / length) if after else F.floor(t / length)
    last = F.floor((t + before) / length)
    return signal.withColumn("slice", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))


def dense(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    return placed(table.column("t").to_numpy(), to_array(table.column("x")))


def apply_stages(signal: DataFrame, stages: list[Stage], length: int = SLICE) -> DataFrame:
    """Run per-sample stages one after the other in a single pass.

    Stages without history need no neighbours and run where the rows lie.
    """
    blocks = [s.block for s in stages]
    history = sum(s.history for s in stages)

    if history == 0 and isinstance(signal, DataFrame):

        def row_wise(batches):
            for batch in batches:
                for rows, x in by_width(batch):
                    for block in blocks:
                        x = block(x)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("recording_id"), rows.column("t"), to_lists(x)], ["recording_id", "t", "x"]
                    )

        return signal.select("recording_id", "t", "x").mapInArrow(row_wise, SIGNAL_DDL)

    def emit(name: str, number: int, first: int, x: np.ndarray, seen: np.ndarray) -> pa.Table:
        for block in blocks:
            x = block(x)
        keep = np.flatnonzero(seen)
        keep = keep[keep + first >= number * length]
        return pa.table(
            {
                "recording_id": pa.array([name] * len(keep), pa.string()),
                "t": pa.array(keep + first, pa.int64()),
                "x": to_lists(x[keep]),
            }
        )

    return _by_slice(signal, emit, SIGNAL_DDL, length, history, 0)


def _by_slice(signal, emit, ddl: str, length: int, before: int, after: int) -> DataFrame:
    """Call ``emit(recording, slice, first sample, samples, present)`` for every
    slice: of recording files where they are read, of a signal after a shuffle."""
    if not isinstance(signal, DataFrame):
        channels = signal.channels

        def scan(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    x = np.frombuffer(r["x"], dtype="<f4").reshape(-1, channels).astype(float)
                    seen = np.frombuffer(r["seen"], dtype=bool)
                    yield from emit(r["recording_id"], r["slice"], r["first_t"], x, seen).to_batches()

        return signal.slices(length, before, after).mapInArrow(scan, ddl)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return emit(key[0].as_py(), key[1].as_py(), *placed(unpacked(table, "t", np.int64), unpacked(table, "x")))

    return packed(signal, length, before, after).groupBy("recording_id", "slice").applyInArrow(run, ddl)


def packed(signal: DataFrame, length: int, before: int, after: int) -> DataFrame:
    """Samples of a task grouped by slice into byte strings, so the shuffle
    moves a few large values instead of one row per sample."""

    def pack(batches):
        for batch in batches:
            for rows, x in by_width(batch):
                yield cut(rows, x)

    def cut(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        t = batch.column("t").to_numpy()
        names = batch.column("recording_id").dictionary_encode()
        owner = names.indices.to_numpy()
        first, last = np.maximum((t - after) // length, 0), (t + before) // length
        copies = last - first + 1
        row = np.repeat(np.arange(len(t)), copies)
        number = np.repeat(first, copies) + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        order = np.lexsort((number, owner[row]))
        row, number = row[order], number[order]
        new = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(owner[row], prepend=-1) != 0))
        ends = np.append(new, len(row))
        return pa.RecordBatch.from_arrays(
            [
                names.dictionary.take(pa.array(owner[row][new])),
                pa.array(number[new]),
                _bytes_at(t[row], ends, 8),
                _bytes_at(x[row], ends, 8 * x.shape[1]),
                pa.array(np.full(len(new), x.shape[1], dtype=np.int32)),
                pa.array(np.maximum.reduceat(t[row], new) if len(new) else t[:0]),
            ],
            ["recording_id", "slice", "t", "x", "channels", "last_t"],
        )

    ddl = "recording_id string, slice long, t binary, x binary, channels int, last_t long"
    return signal.select("recording_id", "t", "x").mapInArrow(pack, ddl)


def _bytes_at(values: np.ndarray, ends: np.ndarray, row_bytes: int) -> pa.Array:
    """One byte string per run of rows, sharing a single buffer."""
    offsets = (ends * row_bytes).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), data])


def unpacked(table: pa.Table, column: str, dtype=np.float64) -> np.ndarray:
    if len(table.column("channels").unique()) > 1:
        raise ValueError("the channel count changes within a recording")
    flat = np.frombuffer(b"".join(v.as_py() for v in table.column(column)), dtype=dtype)
    return flat if column == "t" else flat.reshape(-1, table.column("channels")[0].as_py())


def placed(t: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """First sample number, samples in time order, and which were present."""
    first = int(t.min())
    out = np.full((int(t.max()) - first + 1, x.shape[1]), np.nan)
    seen = np.zeros(len(out), dtype=bool)
    out[t - first] = x
    seen[t - first] = True
    return first, out, seen


def full_windows(seen: np.ndarray, first: int, lead: int, count: int, W: int, H: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows ``lead`` to ``lead + count`` all of whose samples are there, and where they begin in the slice."""
    ks = np.arange(lead, lead + count)
    at = ks * H - first
    whole = (at >= 0) & (at + W <= len(seen))
    ks, at = ks[whole], at[whole]
    filled = np.array([bool(seen[a : a + W].all()) for a in at], dtype=bool)
    return ks[filled], at[filled]


def apply_windows(
    signal: DataFrame, final: WindowStage, W: int, H: int, stages: list[Stage] = (), length: int = SLICE
) -> DataFrame:
    """Cut full windows of W samples every H samples and transform each.

    Window k covers samples [k*H, k*H+W). Leading per-sample stages run on the
    unwindowed slice first, so overlapping samples are filtered once.
    """
    per_slice = max(1, length // H)
    span = per_slice * H
    blocks = [s.block for s in stages]
    history = sum(s.history for s in stages)
    block, bands, hz = final.block, final.bands, final.hz_per_row

    def emit(name: str, number: int, first: int, x: np.ndarray, seen: np.ndarray) -> pa.Table:
        for stage in blocks:
            x = stage(x)
        ks, at = full_windows(seen, first, number * per_slice, per_slice, W, H)
        if len(at):
            y = block(np.stack([x[a : a + W] for a in at]))
        else:
            y = np.zeros((0, 1, max(1, x.shape[1])))
        n, rows, c = y.shape
        i = np.tile(np.arange(rows, dtype=np.int32), n)
        cols = {
            "recording_id": pa.array([name] * (n * rows), pa.string()),
            "window_index": pa.array(np.repeat(ks, rows), pa.int64()),
            "i": pa.array(i, pa.int32()),
        }
        if bands:
            cols["band"] = pa.array([bands[j] for j in i], pa.string())
        if hz is not None:
            cols["freq_hz"] = pa.array(i * hz, pa.float64())
        cols["x"] = to_lists(y.reshape(n * rows, c))
        return pa.table(cols)

    ddl = "recording_id string, window_index long, i int"
    ddl += ", band string" if bands else ""
    ddl += ", freq_hz double" if hz is not None else ""
    return _by_slice(signal, emit, ddl + ", x array<double>", span, history, max(0, W - H))


@dataclass(frozen=True)
class Chain:
    """A named sequence of transforms: ``stages`` on samples, then ``blocks`` (name, function) on windows."""

    name: str
    stages: tuple[Stage, ...]
    blocks: tuple[tuple[str, Callable[[np.ndarray], np.ndarray]], ...]
    bands: tuple[str, ...] = ()
    hz_per_row: float | None = None


CHAINS_DDL = (
    "chain string, recording_id string, window_index long, i int, band string, freq_hz double, x array<double>, window_failed int,"
    " failed_kernel string, error string"
)


def apply_chains(signal: DataFrame, chains: list[Chain], W: int, H: int, length: int = SLICE) -> DataFrame:
    """All chains over one signal in one pass; leading stages that chains share (the same objects) are worked out once.

    A kernel that raises ends its chain alone, and there only the windows it raises on: each is a row that names the kernel and
    the error. If it works on samples, those are the windows of that slice."""
    per_slice = max(1, length // H)
    history = max((sum(s.history for s in c.stages) for c in chains), default=0)

    def rows(chain: Chain, name: str, ks: np.ndarray, y: np.ndarray) -> pa.Table:
        n, lines, c = y.shape
        i = np.tile(np.arange(lines, dtype=np.int32), n)
        band = pa.array([chain.bands[j] for j in i] if chain.bands else [None] * len(i), pa.string())
        hz = pa.array(i * chain.hz_per_row if chain.hz_per_row is not None else [None] * len(i), pa.float64())
        columns = [
            pa.array([chain.name] * len(i), pa.string()), pa.array([name] * len(i), pa.string()), pa.array(np.repeat(ks, lines), pa.int64()), pa.array(i),
            band, hz, to_lists(y.reshape(n * lines, c)), pa.array(np.zeros(len(i), np.int32)), pa.nulls(len(i), pa.string()), pa.nulls(len(i), pa.string()),
        ]
        return pa.Table.from_arrays(columns, names=_CHAIN_NAMES)

    def failures(chain: Chain, name: str, ks: list[int], kernel: str, error: str) -> pa.Table:
        n = len(ks)
        text = lambda v: pa.array([v] * n, pa.string())
        columns = [
            text(chain.name), text(name), pa.array(ks, pa.int64()), pa.array(np.zeros(n, np.int32)), text(None), pa.nulls(n, pa.float64()),
            pa.nulls(n, pa.list_(pa.float64())), pa.array(np.ones(n, np.int32)), text(kernel), text(error),
        ]
        return pa.Table.from_arrays(columns, names=_CHAIN_NAMES)

    def through(chain: Chain, w: np.ndarray) -> tuple[np.ndarray | None, str, str]:
        at = ""
        try:
            for at, block in chain.blocks:
                w = block(w)
            return w, "", ""
        except Exception as e:  # the failure is a row of the result
            return None, at, str(e)

    def of_chain(chain: Chain, name: str, ks: np.ndarray, at: np.ndarray, x: np.ndarray) -> list[pa.Table]:
        cut = np.stack([x[a : a + W] for a in at])
        y, _, _ = through(chain, cut)
        if y is not None:
            return [rows(chain, name, ks, y)]
        out = []  # window by window: those that do not raise are whole
        for j, k in enumerate(ks.tolist()):
            y, kernel, error = through(chain, cut[j : j + 1])
            out.append(failures(chain, name, [k], kernel, error) if y is None else rows(chain, name, np.array([k]), y))
        return out

    def emit(name: str, number: int, first: int, x: np.ndarray, seen: np.ndarray) -> pa.Table:
        ks, at = full_windows(seen, first, number * per_slice, per_slice, W, H)
        out = [pa.Table.from_pylist([], schema=_CHAIN_SCHEMA)]
        done: dict[tuple, np.ndarray] = {(): x}
        for chain in chains if len(ks) else ():
            y, used = x, ()
            try:
                for stage in chain.stages:
                    used = (*used, stage)
                    if used not in done:
                        done[used] = stage.block(y)
                    y = done[used]
            except Exception as e:
                out.append(failures(chain, name, ks.tolist(), used[-1].name, str(e)))
                continue
            out += of_chain(chain, name, ks, at, y)
        return pa.concat_tables(out)

    return _by_slice(signal, emit, CHAINS_DDL, per_slice * H, history, max(0, W - H))


_CHAIN_NAMES = ["chain", "recording_id", "window_index", "i", "band", "freq_hz", "x", "window_failed", "failed_kernel", "error"]
_CHAIN_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.string(), pa.string()]
_CHAIN_SCHEMA = pa.schema(list(zip(_CHAIN_NAMES, _CHAIN_KINDS)))
