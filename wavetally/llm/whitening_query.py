"""All embeddings whitened along eight components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.registry import query
from wavetally.llm.whitening import whiten_vectors


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)
    return rows.selectExpr("vec_id", "component", "n", "CAST(deviation AS BIGINT) AS deviation", "whitened", "explained", "identity_error")
