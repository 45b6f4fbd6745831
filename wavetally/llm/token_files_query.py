"""Token ids of all documents, written to files and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.registry import query
from wavetally.llm.token_files import read, write
from wavetally.session import materialize, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    manifest = materialize(write(table(spark, sf_dir, "documents"), path, TOKENIZER), "manifest")
    return read(spark, path, manifest)
