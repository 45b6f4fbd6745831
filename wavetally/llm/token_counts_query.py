"""Tokens of every document by section: source, language, title line and the rest of the text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.registry import query
from wavetally.llm.token_counts import count_tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), ["source", "lang", "text"], TOKENIZER, rule="largest", title="text")
