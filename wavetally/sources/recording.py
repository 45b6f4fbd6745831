"""Headerless float32 recordings: interleaved [samples, channels].

Readable from any file system pyarrow knows. A recording is one file, or a
folder of parts whose names carry their first sample number, so both reading
and writing are spread over tasks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "float32_recording"
SCHEMA = "recording_id string, t long, x array<float>"
ITEM_BYTES = 4
SPLIT_BYTES = 64 << 20
BATCH_ROWS = 4096
PART = re.compile(r"t(\d+)\.float32$")


@dataclass
class ByteRange(InputPartition):
    path: str
    recording_id: str
    first_t: int
    offset: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def file_system(path: str):
    """File system and path for a local path or a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _listing(path: str, channels: int) -> list[tuple[str, int, int, str]]:
    """(recording, first sample, samples, file) of every file below ``path``.

    A trailing partial sample is left out."""
    from pyarrow import fs

    filesystem, root = file_system(path)
    info = filesystem.get_file_info(root)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        found = filesystem.get_file_info(fs.FileSelector(root, recursive=True))
    out = []
    for f in found:
        if f.type != fs.FileType.File or not f.path.endswith(".float32") or "/_" in f.path[len(root) :]:
            continue
        part = PART.search(f.base_name)
        name = f.path.rsplit("/", 2)[-2] if part else f.base_name[: -len(".float32")]
        first = int(part.group(1)) if part else 0
        out.append((name, first, f.size // (ITEM_BYTES * channels), f.path))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.channels = int(options["channels"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        if self.channels <= 0:
            raise ValueError("channels must be > 0")

    def partitions(self):
        row_bytes = ITEM_BYTES * self.channels
        step = max(1, self.split // row_bytes)
        out = []
        for name, first, rows, file in _listing(self.path, self.channels):
            for at in range(0, rows, step):
                out.append(ByteRange(file, name, first + at, at * row_bytes, min(step, rows - at)))
        return out or [ByteRange("", "", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part.rows == 0:
            return
        filesystem, _ = file_system(self.path)
        c = self.channels
        with filesystem.open_input_file(part.path) as f:
            for at in range(0, part.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, part.rows - at)
                raw = f.read_at(n * c * ITEM_BYTES, part.offset + at * c * ITEM_BYTES)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * c), pa.array(np.frombuffer(raw, dtype="<f4"))
                )
                first = part.first_t + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.recording_id] * n), pa.array(np.arange(first, first + n)), lists],
                    ["recording_id", "t", "x"],
                )


@dataclass
class SliceRange(InputPartition):
    recording_id: str
    first_slice: int
    last_slice: int
    end_t: int
    files: list[tuple[int, int, str]]


class _SliceReader(_Reader):
    """Slices with the samples around them, read straight from the files."""

    def __init__(self, options):
        super().__init__(options)
        self.length = int(options["length"])
        self.before, self.after = int(options["before"]), int(options["after"])

    def partitions(self):
        owners: dict[str, list[tuple[int, int, str]]] = {}
        for name, first, rows, file in _listing(self.path, self.channels):
            if rows:
                owners.setdefault(name, []).append((first, rows, file))
        per_task = max(1, self.split // (ITEM_BYTES * self.channels * self.length))
        out = []
        for name, files in owners.items():
            files.sort()
            end = max(first + rows for first, rows, _ in files)
            last = (end - 1) // self.length
            for s in range(0, last + 1, per_task):
                e = min(last, s + per_task - 1)
                lo, hi = s * self.length - self.before, (e + 1) * self.length + self.after
                near = [f for f in files if f[0] < hi and f[0] + f[1] > lo]
                out.append(SliceRange(name, s, e, end, near))
        return out or [SliceRange("", 0, -1, 0, [])]

    def read(self, part: SliceRange) -> Iterator[pa.RecordBatch]:
        filesystem, _ = file_system(self.path)
        row_bytes = ITEM_BYTES * self.channels
        for s in range(part.first_slice, part.last_slice + 1):
            lo = max(0, s * self.length - self.before)
            hi = min(part.end_t, (s + 1) * self.length + self.after)
            x = np.full((hi - lo, self.channels), np.nan, dtype="<f4")
            seen = np.zeros(hi - lo, dtype=bool)
            for first, rows, file in part.files:
                start, stop = max(lo, first), min(hi, first + rows)
                if start < stop:
                    with filesystem.open_input_file(file) as f:
                        raw = f.read_at((stop - start) * row_bytes, (start - first) * row_bytes)
                    x[start - lo : stop - lo] = np.frombuffer(raw, dtype="<f4").reshape(-1, self.channels)
                    seen[start - lo : stop - lo] = True
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.recording_id]),
                    pa.array([s]),
                    pa.array([lo]),
                    pa.array([x.tobytes()], pa.binary()),
                    pa.array([seen.tobytes()], pa.binary()),
                ],
                ["recording_id", "slice", "first_t", "x", "seen"],
            )


def by_recording(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows of one channel count, in order, with their samples; rows without samples are left out."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(2)))
        if batch.num_rows == 0:
            continue
        widths = pc.list_value_length(batch.column(2)).to_numpy()
        breaks = np.flatnonzero(np.diff(widths)) + 1
        for start, stop in zip([0, *breaks.tolist()], [*breaks.tolist(), len(widths)]):
            part = batch.slice(start, stop - start)
            values = part.column(2).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
            yield part, values.reshape(stop - start, -1)


class _Writer(DataSourceArrowWriter):
    """One file per run of consecutive samples in a task, renamed on commit."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, root = file_system(self.path)
        files: list[tuple[str, str]] = []
        out, owner, expected = None, None, None
        try:
            for batch, rows in by_recording(iterator):
                names = batch.column(0).dictionary_encode()
                ids, ts = names.indices.to_numpy(), batch.column(1).to_numpy()
                breaks = np.flatnonzero((np.diff(ts) != 1) | (np.diff(ids) != 0)) + 1
                for start, stop in zip([0, *breaks], [*breaks, len(ts)]):
                    name, t = names.dictionary[int(ids[start])].as_py(), int(ts[start])
                    if name != owner or t != expected:
                        if out is not None:
                            out.close()
                        temp = f"{root}/_writing/{uuid.uuid4().hex}"
                        filesystem.create_dir(f"{root}/_writing", recursive=True)
                        out = filesystem.open_output_stream(temp)
                        files.append((temp, f"{root}/{name}/t{t:015d}.float32"))
                        owner = name
                    out.write(np.ascontiguousarray(rows[start:stop]).tobytes())
                    expected = int(ts[stop - 1]) + 1
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        filesystem, root = file_system(self.path)
        for m in messages:
            for temp, final in m.files if m else []:
                filesystem.create_dir(final.rsplit("/", 1)[0], recursive=True)
                filesystem.move(temp, final)

    def abort(self, messages):
        filesystem, _ = file_system(self.path)
        for m in messages:
            for temp, _final in m.files if m else []:
                filesystem.delete_file(temp)


class Float32Recording(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


class Float32Slices(DataSource):
    @classmethod
    def name(cls):
        return f"{FORMAT}_slices"

    def schema(self):
        return "recording_id string, slice long, first_t long, x binary, seen binary"

    def reader(self, schema):
        return _SliceReader(self.options)


@dataclass(frozen=True)
class RecordingFiles:
    """Recordings to be processed from their files without a shuffle.

    Takes the place of a signal in filters, spectra and chains: every task reads
    its slices together with the samples around them.
    """

    spark: SparkSession
    path: str
    channels: int
    split_bytes: int = SPLIT_BYTES

    def slices(self, length: int, before: int = 0, after: int = 0) -> DataFrame:
        self.spark.dataSource.register(Float32Slices)
        reader = self.spark.read.format(f"{FORMAT}_slices").option("path", self.path).option("channels", self.channels)
        reader = reader.option("length", length).option("before", before).option("after", after)
        return reader.option("splitbytes", self.split_bytes).load()

    def samples(self) -> DataFrame:
        """The same recordings as one row per sample instant."""
        rows = read_float32(self.spark, self.path, self.channels, self.split_bytes)
        return rows.selectExpr("recording_id", "t", "cast(x as array<double>) AS x")

    @property
    def sparkSession(self) -> SparkSession:
        return self.spark


def read_float32(spark: SparkSession, path: str, channels: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Wide signal (recording_id, t, x) from a file or a folder of parts."""
    spark.dataSource.register(Float32Recording)
    reader = spark.read.format(FORMAT).option("channels", channels).option("splitbytes", split_bytes)
    return reader.option("path", path).load()


def write_float32(signal: DataFrame, path: str) -> None:
    """Range-partitioned by time, one file per run of samples."""
    signal.sparkSession.dataSource.register(Float32Recording)
    rows = signal.selectExpr("recording_id", "cast(t as long) AS t", "cast(x as array<float>) AS x")
    ordered = rows.repartitionByRange("recording_id", "t").sortWithinPartitions("recording_id", "t")
    ordered.write.format(FORMAT).option("path", path).mode("append").save()
