"""Telemetry folders: ``kernel-data/<kernel>/*.ndjson|json|csv``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.schemas import DERIVED, SYSTEM_INFO, TELEMETRY, has

UNNAMED = "(unnamed)"

FULL = T.StructType([*TELEMETRY.fields, *DERIVED.fields, *SYSTEM_INFO.fields])


def _unescaped(name: Column) -> Column:
    """A name with its %XX escapes undone; a plus is a plus, and a percent sign that escapes nothing stays."""
    plain = F.regexp_replace(F.replace(name, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(plain)


def kernel_from_path(path: Column) -> Column:
    """Kernel folder right below ``kernel-data``; null elsewhere.

    File paths come as URIs, whose escapes are undone once; names that partitioned writing escaped (``plugin=``) a second
    time."""
    name = _unescaped(F.regexp_extract(path, r"kernel-data/([^/]+)/[^/]+$", 1))
    written = F.regexp_extract(name, r"^plugin=(.*)$", 1)
    return F.when(written != "", _unescaped(written)).when(name != "", name)


def chain_from_path(path: Column) -> Column:
    """Name of a ``pipeline-*`` folder in the path, null outside of one."""
    name = F.regexp_extract(path, r"/pipeline-([^/]+)/kernel-data/", 1)
    return F.when(name != "", _unescaped(name))


def normalize_plugin(df: DataFrame, path: Column) -> DataFrame:
    """Fill a missing or placeholder kernel name from the folder; rows of files
    outside ``kernel-data/<kernel>/`` are dropped."""
    kernel = kernel_from_path(path)
    given = F.col("plugin") if has(df, "plugin") else F.lit(None).cast("string")
    named = F.when(given.isNull() | (given == UNNAMED), kernel).otherwise(given)
    return df.where(kernel.isNotNull()).withColumn("plugin", named)


def split_system_info(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(telemetry rows, first metadata row of every kernel)."""
    is_info = F.coalesce(F.col("_type") == "system_info", F.lit(False))
    fields = [f.name for f in SYSTEM_INFO if f.name != "_type"]
    order = "_file" if has(df, "_file") else fields[0]
    info = df.where(is_info).groupBy("plugin").agg(F.min_by(F.struct(*fields), order).alias("_i")).select("plugin", "_i.*")
    return df.where(~is_info).drop("_type", *fields), info


def _located(df: DataFrame) -> DataFrame:
    """Add the file path; metadata rows still carry their kernel's folder."""
    located = df.withColumn("_file", F.col("_metadata.file_path"))
    named = normalize_plugin(located, F.col("_file"))
    return named.withColumn("pipeline", chain_from_path(F.col("_file")))


def _ndjson_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    files = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ndjson,json}")
    return _located(files.json(path))


def read_telemetry_ndjson(spark: SparkSession, path: str, schema: T.StructType = FULL) -> DataFrame:
    """Telemetry rows of all kernels below ``path``; missing columns are null."""
    return split_system_info(_ndjson_rows(spark, path, schema))[0].drop("_file")


def read_system_info(spark: SparkSession, path: str) -> DataFrame:
    return split_system_info(_ndjson_rows(spark, path, FULL))[1]


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from CSV with a header; ``#`` lines are skipped.

    Columns are taken by header name and given the type of the telemetry schema.
    """
    reader = spark.read.option("header", True).option("comment", "#").option("recursiveFileLookup", True)
    raw = _located(reader.option("pathGlobFilter", "*.csv").csv(path)).drop("_file")
    kinds = {f.name: f.dataType for f in FULL.fields}
    return raw.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns])


def read_telemetry(spark: SparkSession, path: str, prefer: str = "ndjson") -> DataFrame:
    """The preferred format, or the other one where only that exists."""
    readers = {"ndjson": read_telemetry_ndjson, "csv": read_telemetry_csv}
    pattern = {"ndjson": "*.{ndjson,json}", "csv": "*.csv"}
    order = [prefer, "csv" if prefer == "ndjson" else "ndjson"]
    for kind in order:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern[kind])
        if not files.load(path).select("path").isEmpty():
            return readers[kind](spark, path)
    raise FileNotFoundError(f"no telemetry below {path}")


def write_telemetry_ndjson(df: DataFrame, path: str, system_info: DataFrame | None = None) -> None:
    """One folder per kernel; metadata goes to its own folder beside them."""
    df.write.partitionBy("plugin").mode("overwrite").json(f"{path}/kernel-data")
    if system_info is not None:
        system_info.write.mode("overwrite").json(f"{path}/system-info")


def write_telemetry_csv(df: DataFrame, path: str) -> None:
    df.write.partitionBy("plugin").mode("overwrite").option("header", True).csv(f"{path}/kernel-data")
