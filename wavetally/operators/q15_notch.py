"""Integer notch filter over recordings of any length, bit-exact.

Rounding and saturation make the recursion non-linear, so what slices do cannot be
added up. But two runs over the same input soon meet, whatever their states were, and
from there on they are one run. So slices are run side by side from guessed states,
and what was guessed wrong is run again only until it meets what is there.

* **Inside a task** a slice is cut into blocks that run side by side as well, each after
  a warm-up from silence; a block that started wrong is mended up to where it meets
  its first run.
* **Between slices** the true end of the slice before is compared with the start
  that was guessed. Slices that started wrong, with those behind them, form stretches; a
  stretch is mended by one task, slice by slice, handing the state on. Stretches
  grow eightfold from pass to pass, so the passes grow with the logarithm of the number of
  slices, even where runs never meet.
* **Constant input** is where they never meet: a rounded recursion does not decay to
  silence but ends in a limit cycle, and which one depends on all that came before.
  There the state alone decides what follows, so the first state that comes
  back gives the rest, and a stretch of silence costs as much as its transient.

Missing samples are 0, single ones as well as whole slices; they have no output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavetally.functions.fixedpoint import Q15_MAX, Q15_MIN
from wavetally.operators.blocks import SLICE, packed, placed, to_lists, unpacked
from wavetally.operators.ordered import broadcast_if_small, previous_values
from wavetally.session import materialize

Q14_BITS = 14
Q14_HALF = 8192

WARM = 1024
BLOCK = 2048
# Constant input is watched for so many steps before a state that has come back is looked for.
PROBE = 512
# Mended runs are compared with what is there after so many steps.
STRIDE = 64
FIRST_STRETCH = 8


def _driven(x: np.ndarray, state: np.ndarray, c: list[int]) -> np.ndarray:
    """What the input adds to every step."""
    both = np.concatenate([state[1:2], state[0:1], x])
    return c[0] * x + c[1] * both[1:-1] + c[2] * both[:-2]


def _loop(driven: np.ndarray, y1: np.ndarray, y2: np.ndarray, c: list[int], out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a1, a2 = c[3], c[4]
    for n in range(len(driven)):
        acc = driven[n] - a1 * y1
        acc -= a2 * y2
        acc += Q14_HALF
        acc >>= Q14_BITS
        np.maximum(acc, Q15_MIN, out=acc)
        np.minimum(acc, Q15_MAX, out=acc)
        out[n] = acc
        y1, y2 = acc, y1
    return y1, y2


def _periods(tail: np.ndarray) -> np.ndarray | None:
    """Per channel the steps since its state was last what it is at the end, or None if one has not come back."""
    back = ((tail[1:] == tail[-1]) & (tail[:-1] == tail[-2]))[:-1]
    found = back[::-1].argmax(axis=0) + 1
    return found if back.any(axis=0).all() else None


def steps(x: np.ndarray, state: np.ndarray, c: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Output (samples, channels) and end state of the recursion; a state is x1, x2, y1, y2."""
    if not len(x):
        return x.copy(), state
    driven = _driven(x, state, c)
    out = np.empty_like(driven)
    y1, y2 = state[2], state[3]
    change = np.flatnonzero((driven[1:] != driven[:-1]).any(axis=1)) + 1
    starts = np.concatenate([[0], change])
    lengths = np.diff(np.append(starts, len(x)))
    quiet = np.flatnonzero(lengths > 2 * PROBE)
    at = 0
    for begin, end in [*((int(starts[q]), int(starts[q] + lengths[q])) for q in quiet), (len(x), len(x))]:
        y1, y2 = _loop(driven[at:begin], y1, y2, c, out[at:begin])
        at = begin
        while at < end:
            to = min(end, at + PROBE)
            y1, y2 = _loop(driven[at:to], y1, y2, c, out[at:to])
            at = to
            period = _periods(out[to - PROBE : to]) if to < end and to - begin >= PROBE else None
            if period is not None:
                ahead = np.arange(end - to)[:, None] % period
                out[to:end] = np.take_along_axis(out, to - period + ahead, axis=0)
                y1, y2 = out[end - 1].copy(), out[end - 2].copy()
                at = end
    return out, np.stack([*_inputs(x, state), y1, y2])


def _inputs(x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x[-1], x[-2]) if len(x) > 1 else (x[-1], state[0])


def silence(state: np.ndarray, n: int, c: list[int]) -> np.ndarray:
    """The state after ``n`` samples of 0; its cost does not grow with ``n`` once the state has come back."""
    while n > 0:
        now = min(n, 4 * PROBE)
        y, state = steps(np.zeros((now, state.shape[1]), dtype=np.int64), state, c)
        n -= now
        period = _periods(y[-2 * PROBE :]) if n and now == 4 * PROBE else None
        if period is not None:
            at = len(y) - 1 + n % period - np.where(n % period > 0, period, 0)
            each = np.arange(y.shape[1])
            zero = np.zeros_like(state[0])
            return np.stack([zero, zero, y[at, each], y[at - 1, each]])
    return state


def mended(x: np.ndarray, state: np.ndarray, y: np.ndarray, end: np.ndarray, c: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Output and end state from ``state``, where ``y`` and ``end`` are those of another start: run until both meet."""
    out, at = y.copy(), 0
    while at < len(x):
        to = min(len(x), at + STRIDE)
        if at >= 2 * PROBE:
            to = len(x)  # they do not meet soon: on in one go, constant stretches by their cycle
        out[at:to], state = steps(x[at:to], state, c)
        at = to
        if at >= 2 and (out[at - 2 : at] == y[at - 2 : at]).all():
            return out, end
    return out, state


def side_by_side(x: np.ndarray, state: np.ndarray, c: list[int], block: int = BLOCK, warm: int = WARM) -> tuple[np.ndarray, np.ndarray]:
    """As ``steps``, with blocks run at once."""
    blocks = len(x) // block
    if blocks < 2 or warm > block:
        return steps(x, state, c)
    k = x.shape[1]
    lead = np.concatenate([np.zeros((warm, k), dtype=np.int64), x[: blocks * block]])
    wide = np.stack([lead[b * block : b * block + warm + block] for b in range(blocks)], axis=1).reshape(warm + block, -1)
    zero = np.zeros((4, wide.shape[1]), dtype=np.int64)
    _, start = steps(wide[:warm], zero, c)
    start[:, :k] = state
    y, end = steps(wide[warm:], start, c)
    y, start, end = y.reshape(block, blocks, k), start.reshape(4, blocks, k), end.reshape(4, blocks, k)
    out = np.empty((len(x), k), dtype=np.int64)
    now = state
    for b in range(blocks):
        own = slice(b * block, (b + 1) * block)
        if (start[:, b] == now).all():
            out[own], now = y[:, b], end[:, b]
        else:
            out[own], now = mended(x[own], now, y[:, b], end[:, b], c)
    out[blocks * block :], now = steps(x[blocks * block :], now, c)
    return out, now


# ------------------------------------------------------------------ slices

SLICE_DDL = "recording_id string, slice long, channels int, seen binary, x binary, y binary, s_in binary, s_out binary"
_NAMES = ["recording_id", "slice", "channels", "seen", "x", "y", "s_in", "s_out"]


def _slice_row(name, number, seen, x, y, s_in, s_out) -> pa.Table:
    narrow = lambda v: np.ascontiguousarray(v).astype("<i2").tobytes()
    cells = [name, number, x.shape[1], np.packbits(seen).tobytes(), narrow(x), narrow(y), narrow(s_in), narrow(s_out)]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(cells, kinds)], names=_NAMES)


def _ints(value: bytes, channels: int) -> np.ndarray:
    return np.frombuffer(value, dtype="<i2").reshape(-1, channels).astype(np.int64)


def guessed(signal: DataFrame, coeffs: list[int], length: int, warm: int) -> DataFrame:
    """Every slice run after a warm-up over the samples before it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        name, number = key[0].as_py(), key[1].as_py()
        first, values, there = placed(unpacked(table, "t", np.int64), unpacked(table, "x"))
        start = number * length
        x = np.zeros((warm + length, values.shape[1]), dtype=np.int64)
        seen = np.zeros(warm + length, dtype=bool)
        at = first - (start - warm)
        x[at : at + len(values)] = np.nan_to_num(values, nan=0.0).astype(np.int64)
        seen[at : at + len(values)] = there
        if not seen[warm:].any():  # only a slice's lead: nothing of its own
            return pa.Table.from_pylist([], schema=pa.schema(list(zip(_NAMES, [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5]))))
        _, s_in = steps(x[:warm], np.zeros((4, x.shape[1]), dtype=np.int64), coeffs)
        y, s_out = side_by_side(x[warm:], s_in, coeffs)
        return _slice_row(name, number, seen[warm:], x[warm:], y, s_in, s_out)

    return packed(signal, length, warm, 0).groupBy("recording_id", "slice").applyInArrow(run, SLICE_DDL)


def wrong_starts(slices: DataFrame, coeffs: list[int], length: int) -> DataFrame:
    """Slices that did not start from the end of the one before: recording_id, slice, and the state ``s`` they should start from."""
    states = slices.select("recording_id", "slice", "channels", "s_in", "s_out")
    pairs = previous_values(states, ["recording_id"], "slice", {"slice": "before", "s_out": "handed", "channels": "width"})
    # most neighbours agree byte by byte and never reach Python
    pairs = pairs.where("before IS NOT NULL AND (slice > before + 1 OR handed != s_in)")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if r["width"] != r["channels"]:
                    raise ValueError("the channel count changes within a recording")
                state = silence(_ints(r["handed"], r["channels"]), (r["slice"] - r["before"] - 1) * length, coeffs)
                if (state != _ints(r["s_in"], r["channels"])).any():
                    found.append((r["recording_id"], r["slice"], state.astype("<i2").tobytes()))
            cells = list(zip(*found)) or [[], [], []]
            kinds = [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cells, kinds)], ["recording_id", "slice", "s"])

    return pairs.mapInArrow(compare, "recording_id string, slice long, s binary")


def stretches(wrong: DataFrame, reach: int) -> DataFrame:
    """Wrong slices at most ``reach`` apart, with ``reach`` slices behind the last: recording_id, stretch, slice, and ``s`` where known."""
    by_slice = Window.partitionBy("recording_id").orderBy("slice")
    fresh = F.coalesce(F.col("slice") - F.lag("slice").over(by_slice) > reach, F.lit(True))
    numbered = wrong.withColumn("_fresh", fresh.cast("int"))
    upto = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = numbered.withColumn("stretch", F.sum("_fresh").over(upto)).withColumn("_next", F.lead("slice").over(by_slice))
    # up to the next wrong slice, but ``reach`` slices at most
    until = F.least(F.coalesce("_next", F.col("slice") + reach), F.col("slice") + reach) - 1
    each = numbered.withColumn("_each", F.explode(F.sequence("slice", until)))
    given = F.when((F.col("_each") == F.col("slice")) & (F.col("_fresh") == 1), F.col("s"))
    return each.select("recording_id", "stretch", F.col("_each").alias("slice"), given.alias("s"))


def refolded(slices: DataFrame, wanted: DataFrame, coeffs: list[int], length: int) -> DataFrame:
    """The slices of each stretch that change, run one after the other in one task per stretch."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, last = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                k = r["channels"]
                if (r["recording_id"], r["stretch"]) != held:
                    held, state = (r["recording_id"], r["stretch"]), _ints(r["s"], k)
                else:
                    state = silence(state, (r["slice"] - last - 1) * length, coeffs)
                last, s_in, s_out = r["slice"], _ints(r["s_in"], k), _ints(r["s_out"], k)
                if (state == s_in).all():
                    state = s_out
                    continue
                x, start = _ints(r["x"], k), state
                y, state = mended(x, start, _ints(r["y"], k), s_out, coeffs)
                seen = np.unpackbits(np.frombuffer(r["seen"], np.uint8), count=len(x)).astype(bool)
                yield from _slice_row(r["recording_id"], last, seen, x, y, start, state).to_batches()

    rows = slices.join(broadcast_if_small(wanted), ["recording_id", "slice"])
    dealt = rows.repartition("recording_id", "stretch").sortWithinPartitions("recording_id", "stretch", "slice")
    return dealt.mapInArrow(fold, SLICE_DDL)


def run_notch(signal: DataFrame, coeffs: list[int], length: int = SLICE, warm: int = WARM) -> tuple[DataFrame, int]:
    """Output rows (recording_id, t, x) and how many passes of mending it took."""
    slices, reach, passes = materialize(guessed(signal, coeffs, length, warm), "q15-notch"), FIRST_STRETCH, 0
    while True:
        wrong = materialize(wrong_starts(slices, coeffs, length), "q15-wrong")
        if wrong.isEmpty():
            break
        wanted = materialize(stretches(wrong, reach), "q15-stretches")
        changed = materialize(refolded(slices, wanted, coeffs, length), "q15-mended")
        keys = broadcast_if_small(changed.select("recording_id", "slice"))
        slices = materialize(slices.join(keys, ["recording_id", "slice"], "left_anti").unionByName(changed), "q15-notch")
        reach *= FIRST_STRETCH
        passes += 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, number, k, seen, y = (batch.column(j)[i].as_py() for j in range(5))
                y = np.frombuffer(y, dtype="<i2").reshape(-1, k)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(seen, np.uint8), count=len(y)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(number * length + at), to_lists(y[at])], ["recording_id", "t", "x"]
                )

    out = slices.select("recording_id", "slice", "channels", "seen", "y").mapInArrow(rows, "recording_id string, t long, x array<smallint>")
    return out, passes
