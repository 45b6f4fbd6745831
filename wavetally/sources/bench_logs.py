"""Scalability benchmark logs, ``scalability_<channels>ch.log``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_bench_logs(spark: SparkSession, path: str) -> DataFrame:
    """Per log: channels, file size, whether data was generated, success.

    Logs are scanned line by line and summed per file, so their length is free.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "scalability_*ch.log")
    lines = files.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    line = F.col("value")
    size = F.regexp_extract(line, r"\[\w+\] File size: ([\d.]+) MB", 1)
    done = line.contains("Benchmark completed") | line.contains("telemetry.ndjson")
    per_file = lines.groupBy("file").agg(
        F.min(F.when(size != "", size.cast("double"))).alias("file_size_mb"),
        F.bool_or(line.rlike(r"\[\w+\] Generated file:")).alias("has_generation"),
        F.bool_or(done).alias("success"),
    )
    channels = F.regexp_extract("file", r"scalability_(\d+)ch\.log$", 1)
    return per_file.where(channels != "").select(
        channels.cast("long").alias("channels"), "file_size_mb", "has_generation", "success"
    )
