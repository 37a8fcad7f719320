"""Queries on packing and periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import packing, runs
from waymark.llm.registry import query, table


@query("op12_packing")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; a tokenizer has no SQL."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """Texts of every tenth draw go on with a word stretch of their own; a null id is no draw."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        period = F.floor((n - a) / (3 + g % 8)) + 1
        word = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")

    # a list of one list binds the words to a name, so that they are split once
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text)), 0)
    return F.when(doc_id.isNotNull() & (h % 10 == 0), planted).otherwise(text)


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four and more periods in all documents; catching squares has no SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find_runs(docs, F.col("doc_id").alias("doc_id"))
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n"),
                     F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.shorter") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
