"""The query on similar documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import similar
from waymark.llm.registry import query, table

# All pairs that share a shingle, and the smallest id that links reach.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, UNNEST(generate_series(1, GREATEST(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING COUNT(*) >= 0.8 * (x.n + y.n - COUNT(*)) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(LEAST(d.doc_id, COALESCE((SELECT MIN(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS BIGINT) AS class_id,
       (SELECT COUNT(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d
"""


@query("op5_jaccard_join", OP5_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents whose five-word shingles have a similarity of 0.8 and more."""
    return similar.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
