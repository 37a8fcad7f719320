"""Queries on documents: mixing, decontamination, language, language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, kneser, language, mixing
from waymark.llm.registry import query, table

# Seats are listed one by one here, which the operator never does.
OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix/' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, 3 * size AS cap FROM sources),
levels AS (
  SELECT *, (SUM(size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / SUM(weight) OVER (ORDER BY cap / weight DESC, place DESC) AS level
  FROM weighed),
shares AS (SELECT COALESCE(arg_min(level, cap / weight) FILTER (WHERE level * weight < cap), MAX(cap / weight)) AS share FROM levels),
targets AS (SELECT w.*, LEAST(CAST(cap AS DOUBLE), share * weight) AS target FROM weighed w, shares),
seats AS (
  SELECT source, place, (2 * k + 1) / (target / 16) AS key
  FROM (SELECT source, place, target, UNNEST(generate_series(0, CAST(target / 16 AS BIGINT) + (SELECT COUNT(*) FROM sources))) AS k
        FROM targets WHERE target > 0)),
won AS (
  SELECT source, COUNT(*) AS blocks
  FROM (SELECT source, row_number() OVER (ORDER BY key, place) AS n FROM seats)
  WHERE n <= (SELECT floor(SUM(target / 16) + 0.53) FROM targets) GROUP BY source),
placed AS (
  SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM sizes),
words AS (
  SELECT p.doc_id, p.source, p.size, p.first, t.size AS source_size, t.target, COALESCE(w.blocks, 0) AS blocks,
         LEAST(COALESCE(w.blocks, 0) * 16, 3 * t.size) AS words
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN won w ON p.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, source, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         size * (words // source_size) + LEAST(GREATEST(words % source_size - first, 0), size) END AS BIGINT) AS taken,
       CAST(blocks AS BIGINT) AS blocks
FROM words
"""


@query("op1_source_mix", OP1_SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source weights 1, 2, 3 with at most three laps."""
    return mixing.mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH tokens AS (
  SELECT row_number() OVER () AS r, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, list_aggregate(w[k:k + 9], 'string_agg', ' ') AS win, LEAST(len(w), 10) AS width
  FROM (SELECT item, w, UNNEST(generate_series(1, GREATEST(1, len(w) - 9))) AS k FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
grams AS (
  SELECT r, k, width, list_aggregate(w[k:k + width - 1], 'string_agg', ' ') AS win
  FROM (SELECT r, w, width, UNNEST(generate_series(1, len(w) - width + 1)) AS k FROM tokens, widths)),
hits AS (SELECT r, k, g.width, item FROM grams g JOIN windows USING (win) WHERE g.width = windows.width),
words AS (SELECT r, COUNT(DISTINCT pos) AS n_hit FROM (SELECT r, UNNEST(generate_series(k, k + width - 1)) AS pos FROM (SELECT DISTINCT r, k, width FROM hits)) GROUP BY r),
named AS (SELECT r, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM tokens LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


@query("op4_decontamination", OP4_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    return decontaminate.report(decontaminate.phrase_hits(index, table(spark, sf_dir, "benchmark"), window=10))


@query("op8_language")
def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by frozen context trees; no SQL can express the code lengths."""
    docs = table(spark, sf_dir, "documents")
    kept = (F.col("doc_id").alias("doc_id"), language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(docs, language.learn(docs, per_language=400), *kept)


@query("op2_language_model")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of six in seven of them; sums of logarithms have no exact SQL."""
    docs = table(spark, sf_dir, "documents")
    out = kneser.held_out(F.col("doc_id"))
    model = kneser.train(docs.filter(~out))
    return kneser.score(docs, model, F.col("doc_id").alias("doc_id"), out.alias("held_out"))
