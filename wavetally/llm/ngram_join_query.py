"""Near-duplicate components of all documents on five-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.ngram_join import components
from wavetally.llm.registry import query

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram
  FROM w),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
kept AS MATERIALIZED (SELECT * FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1)),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM kept a JOIN kept b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM overlap JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
twoway AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, a AS other FROM twoway
  UNION
  SELECT reach.doc_id, twoway.b FROM reach JOIN twoway ON twoway.a = reach.other)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(r.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN size USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query("op1_ngram_jaccard_join", SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
