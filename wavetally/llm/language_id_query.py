"""Language of every document, learnt from the documents outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.language_id import held_out, identify, train
from wavetally.llm.registry import query


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
