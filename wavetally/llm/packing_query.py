"""All documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.packing import Capacity, cut, pack
from wavetally.llm.registry import query

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = Capacity(tokens=2048)
    return pack(cut(table(spark, sf_dir, "documents"), TOKENIZER, capacity.tokens), capacity)
