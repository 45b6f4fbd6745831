"""Benchmark items leaked into the documents, one row per document and item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.llm.common import table
from wavetally.llm.decontamination import with_leaks
from wavetally.llm.registry import query


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))
