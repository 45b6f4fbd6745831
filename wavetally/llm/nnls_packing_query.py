"""All documents packed by least squares on the histogram of their lengths."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.nnls_packing import pack_by_histogram
from wavetally.llm.registry import query

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op12_nnls_packing")
def op12_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_histogram(table(spark, sf_dir, "documents"), TOKENIZER, size=2048, end_id=1)
