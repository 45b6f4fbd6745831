"""The quality rule ledger over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.quality_rules import apply_policy, ledger
from wavetally.llm.registry import query

SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: {'pos': i, 'g': words[i:i + 7]}), recursive := true)
  FROM w),
twice AS (SELECT doc_id, pos FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CAST(len(list_filter(words, lambda x: regexp_matches(x, '[A-Z][^a-z]*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT)
           AS n_shouted
  FROM w),
m AS (
  SELECT base.* EXCLUDE (lines), CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT
       + 8 * (100 * n_shouted > 50 * n_words)::INT + 16 * (100 * n_dup_lines > 30 * n_lines)::INT
       + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 25 * n_words)::INT AS BIGINT) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures,
       (failures & 3) <> 0 AS base_failed,
       (failures & 15) = 0 AND bit_count(failures & 112) <= 1 AS kept
FROM f
"""


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).selectExpr(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "failures",
        "(failures & 3) <> 0 AS base_failed",
        "kept",
    )
