"""Float32 recordings as a stream, while their files grow.

Offsets say which samples of each recording have been read, as ranges ``from-to``: parts that follow one another are one
range, so an offset grows with the number of recordings and gaps, not with files or time. A batch is what lies between
two offsets, cut into byte ranges, so a query that was stopped goes on in the middle of a file, a part that comes
late or out of order is read when it is there, and a sample that two files hold is read once. A trailing partial sample waits for its
rest. Nothing is copied or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from wavetally.sources.recording import FORMAT, ITEM_BYTES, SCHEMA, SPLIT_BYTES, ByteRange, _listing, _Reader

Ranges = list[tuple[int, int]]


def merged(ranges: Ranges) -> Ranges:
    """Disjoint ranges in order; those that touch are one."""
    out: Ranges = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif b > a:
            out.append((a, b))
    return out


def without(ranges: Ranges, gone: Ranges) -> Ranges:
    """What of ``ranges`` lies outside ``gone``; both disjoint and in order."""
    out: Ranges = []
    for a, b in ranges:
        for c, d in gone:
            if d <= a or c >= b:
                continue
            if c > a:
                out.append((a, c))
            a = max(a, d)
        if a < b:
            out.append((a, b))
    return out


def written(ranges: Ranges) -> str:
    return ",".join(f"{a}-{b}" for a, b in ranges)


def read_back(text: str) -> Ranges:
    return [(int(a), int(b)) for a, b in (r.split("-") for r in text.split(",") if r)]


class RecordingStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.batch = _Reader(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found: dict[str, Ranges] = {}
        for name, first, rows, _ in _listing(self.batch.path, self.batch.channels):
            found.setdefault(name, []).append((first, first + rows))
        return {name: written(merged(r)) for name, r in sorted(found.items()) if merged(r)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        row_bytes = ITEM_BYTES * self.batch.channels
        step = max(1, self.batch.split // row_bytes)
        new = {name: without(read_back(r), read_back(start.get(name, ""))) for name, r in end.items() if start.get(name) != r}
        out = []
        for name, first, rows, file in sorted(_listing(self.batch.path, self.batch.channels)) if any(new.values()) else []:
            wanted = new.get(name, [])
            mine = without([(first, first + rows)], without([(first, first + rows)], wanted))  # what both have
            new[name] = without(wanted, mine)
            for a, b in mine:
                for at in range(a, b, step):
                    out.append(ByteRange(file, name, at, (at - first) * row_bytes, min(step, b - at)))
        missing = {name: written(r) for name, r in new.items() if r}
        if missing:
            raise FileNotFoundError(f"samples of an offset are gone: {missing}")
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)


class RecordingStream(DataSource):
    @classmethod
    def name(cls):
        return f"{FORMAT}_stream"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return RecordingStreamReader(self.options)


def recording_stream(spark: SparkSession, path: str, channels: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Samples (recording_id, t, x) of a file or a folder of parts, as they come."""
    spark.dataSource.register(RecordingStream)
    reader = spark.readStream.format(RecordingStream.name()).option("path", path).option("channels", channels)
    return reader.option("splitbytes", split_bytes).load().selectExpr("recording_id", "t", "cast(x AS array<double>) AS x")
