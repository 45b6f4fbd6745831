"""Expected grade and selection of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.quality_classifier import score, train
from wavetally.llm.registry import query


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "expected_grade", "p_good", "kept")
