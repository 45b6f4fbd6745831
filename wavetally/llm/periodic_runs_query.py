"""Periodic runs of all documents, a tenth of which get a repeating end first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavetally.llm.common import table
from wavetally.llm.periodic_runs import collapse_runs
from wavetally.llm.registry import query

# DuckDB has no crc32: eight shifts for every digit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
  4294967295)"""

SQL = rf"""
WITH t AS (
  SELECT doc_id, {CRC32} AS h,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (SELECT *, h // 10 AS g, len(words) AS n FROM t),
a AS (SELECT *, g % greatest(n, 1) AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
s AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words
  FROM p),
w AS (SELECT doc_id, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM s),
d AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM d),
r AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
m AS (
  SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start
    AND s.start + s.length >= r.start + r.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM m),
c AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
         arg_max({{'start': start, 'length': length, 'q': q}}, [length, -start, -q]) AS top
  FROM m GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length,
       CAST(top.q AS BIGINT) AS period, CAST(1000 * top.length // top.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM s LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def with_repeats(docs: DataFrame) -> DataFrame:
    """One document in ten, by the crc32 of its id, with its words repeating from some word on; the others as they are."""
    hashed = docs.selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) AS h")
    split = hashed.selectExpr(
        "doc_id", "text", "h div 10 AS g", r"IF(h % 10 = 0, filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> ''), null) AS words"
    )
    cut = split.selectExpr("doc_id", "text", "words", "g", "g % greatest(size(words), 1) AS a")
    period = cut.selectExpr("doc_id", "text", "words", "a", "1 + (size(words) - a) div (3 + g % 8) AS p")
    return period.selectExpr(
        "doc_id",
        "IF(words IS NULL, text, concat_ws(' ', transform(words, (w, i) -> IF(i < a, w, words[int(a + (i - a) % p)])))) AS text",
    )


@query("op13_periodic_runs", SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_repeats(table(spark, sf_dir, "documents")))
    top = "array_max(transform(runs, r -> struct(r.length, -r.start, -r.period)))"
    listed = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"
    return found.selectExpr("doc_id", "runs", "collapsed", f"{top} AS top").selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "-top.col2 AS start",
        "top.length AS length",
        "-top.col3 AS period",
        "1000 * top.length div -top.col3 AS exponent_milli",
        f"sha2({listed}, 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )
