"""The query on secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import secrets
from waymark.llm.registry import query, table


def _sql() -> str:
    """Per kind, positions from the pieces between matches; links by an explicit pair test."""
    scans = []
    for p in secrets.PARTS:
        pattern = p.pattern.replace("'", "''")
        test = "len(m) = 40 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')" if p.weak == "key" else "true"
        scans.append(f"""
  SELECT r, '{p.base}' AS base_kind, '{p.weak}' AS weak_kind, '{p.role}' AS role, {p.least} AS least, {p.weak_least} AS weak_least, {test} AS mixed,
         len(regexp_extract(m, '{pattern}', {p.group})) AS size, len(m) AS length,
         SUM(len(piece) + len(m)) OVER (PARTITION BY r ORDER BY k) AS stop
  FROM (SELECT r, UNNEST(generate_series(1, len(ms))) AS k, UNNEST(ms) AS m, UNNEST(pieces[1:len(ms)]) AS piece
        FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS ms, string_split_regex(text, '{pattern}') AS pieces FROM docs))""")
    kinds = ", ".join(f"'{k}'" for k in secrets.KINDS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(scans)}),
parts AS (
  SELECT row_number() OVER () AS p, r, role, stop - length AS start, stop, base_kind <> '' AND size >= least AS base,
         CASE WHEN base_kind <> '' AND size >= least THEN base_kind ELSE weak_kind END AS kind
  FROM found WHERE (base_kind <> '' AND size >= least) OR (size >= weak_least AND mixed)),
near AS (
  SELECT a.p, bool_or(b.role = 'secret') AS secret, bool_or(b.role = 'identifier') AS identifier
  FROM parts a JOIN parts b ON a.r = b.r AND a.p <> b.p AND a.start - b.stop <= {secrets.REACH} AND b.start - a.stop <= {secrets.REACH}
  GROUP BY a.p),
kept AS (
  SELECT r, kind, start, base, kind || ':' || start || ':' || stop AS name, list_position([{kinds}], kind) AS place
  FROM parts LEFT JOIN near USING (p)
  WHERE base OR (role = 'identifier' AND secret) OR (role = 'secret' AND identifier) OR (role = 'endpoint' AND secret AND identifier)),
per_doc AS (
  SELECT r, COUNT(*) FILTER (WHERE kind = 'assign') AS n_assign, COUNT(*) FILTER (WHERE kind = 'access') AS n_access,
         COUNT(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(name, ',' ORDER BY start, place) FILTER (WHERE base) AS base,
         string_agg(name, ',' ORDER BY start, place) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM docs LEFT JOIN per_doc USING (r)
"""


@query("op6_secrets", _sql())
def secrets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of all documents."""
    return secrets.report(table(spark, sf_dir, "documents"))
