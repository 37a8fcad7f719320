"""Queries on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import warc, wrappers
from waymark.llm.registry import query, table

# Five hex digits are four letters of base 32. The URL key is left to string functions.
OP3_SQL = r"""
WITH pages_ AS (
  SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex,
         regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)(:[0-9]+)?([^?#]*)([?][^#]*)?', ['host', 'port', 'path', 'query']) AS u
  FROM pages),
coded AS (
  SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS digest,
         MIN(page_id) OVER (PARTITION BY hex) AS first_id
  FROM pages_)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(u.host, '^www[.]', ''), '.')), ',') || u.port || ')'
         || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN u.query = '?' THEN '' ELSE u.query END AS urlkey,
       strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS captured
FROM coded
"""


@query("op3_warc", OP3_SQL)
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, indexed, merged and read back."""
    runs = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archives(warc.merge_runs(runs))


@query("op9_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages by host wrappers; no SQL can express the alignment."""
    return wrappers.extract(table(spark, sf_dir, "pages"))
