"""What the text operators share: reading tables, cutting batches, 64-bit mixing, broadcasting within a bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Text handled at once inside a task. A longer single text is still handled whole.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with the columns of ``ddl`` behind those of ``schema``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys as the signed ones Spark has."""
    return x.view(np.int64)


def power_of_two(n: float, least: int, most: int) -> int:
    """The power of two next above ``n``, within bounds that are powers of two."""
    return int(min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(n, 1))))))))
