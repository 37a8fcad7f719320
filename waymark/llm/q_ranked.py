"""Query on ranked lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import ranked
from waymark.llm.registry import query, table
from waymark.llm.scratch import Scratch

OP11_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
docs AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM doc_terms WHERE len(w) > 0),
totals AS (SELECT CAST(COUNT(*) AS BIGINT) AS N_, CAST(SUM(n) AS BIGINT) AS L_ FROM docs),
item_terms AS (
  SELECT i, item_id, term, CAST(COUNT(*) AS BIGINT) AS repeats
  FROM (SELECT row_number() OVER () AS i, item_id,
               UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY i, item_id, term),
tfs AS (
  SELECT r, term, CAST(COUNT(*) AS BIGINT) AS tf FROM (SELECT r, UNNEST(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tfs, totals GROUP BY term, N_),
scored AS (
  SELECT i, item_id, doc_id, r,
         CAST(SUM(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L_)))) AS BIGINT) AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (r), totals GROUP BY i, item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_ranked_search", OP11_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of all for every benchmark item."""
    step = Scratch(spark)
    return ranked.search(ranked.build_index(table(spark, sf_dir, "documents"), step), table(spark, sf_dir, "benchmark"), step, k=20)
