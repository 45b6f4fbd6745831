"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes every stage's
result to the shared folder and reads it back, so that a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetally.llm.common import table
from wavetally.llm.decontamination import decontaminated
from wavetally.llm.language_id import UNKNOWN, held_out, identify, train
from wavetally.llm.line_dedup import drop_repeated_lines
from wavetally.llm.ngram_join import one_of_each
from wavetally.llm.packing import Capacity, cut, pack
from wavetally.session import materialize

#: Share of n-grams the best language must know. Texts below it are in no learnt language.
LEAST_SCORE = 0.1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = Capacity(tokens=2048)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; ``lang`` becomes the predicted one."""
    model = train(docs.where(~held_out()))
    kept = identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that three or more documents share; documents left without text go."""
    kept = drop_repeated_lines(docs).where("trim(text) <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: that of least doc_id (null last), ties by a hash of id and text."""
    return one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return pack(cut(docs, TOKENIZER, CAPACITY.tokens), CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing, alignment and filters are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
