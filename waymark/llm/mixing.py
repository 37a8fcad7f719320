"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: the sources share all words by weight; no target exceeds ``max_epochs`` times its source, and the excess is
shared again by weight until none does. The mix is dealt in blocks of ``block_words`` words: the n-th seat goes to the
source with the highest quotient ``target / (2 * seats so far + 1)``, ties to the source that comes first. Seats are
never listed one by one. With S sources and H seats, the divisor that fills h seats lies within S of 2h, so all but
about 2 S seats per cut are known from a closed form and only those are ranked. Cuts at the ends of the output shards
give each shard's integer quota of blocks per source. A source's blocks are taken in the order of a seeded hash of its
documents, end to end and over again: block k covers words ``k * block_words`` and on, modulo the source's size.

Defined cases: a null source is a source of its own and sorts last; a null or empty text has size 0 and gives nothing;
rows that agree in source, id and size stand in an arbitrary order, which changes no result row. Without words all
targets are 0. Sizes and quotas of a source with a third of all rows are sums over hash buckets of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def document_sizes(docs: DataFrame, seed: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, draw`` of each document, written once; ``draw`` is its seeded place."""
    identity = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.concat(F.lit(seed + "/"), identity)).alias("draw")))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its place from 0 in a total order, counted over a range partitioning instead of in one task."""
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").count()  # one row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_n", F.row_number().over(within)).join(before, "_part").withColumn(
        name, F.col("_before") + F.col("_n") - 1).drop("_part", "_n", "_before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``source, size, place, weight, target``; the weights repeat over the sources in code point order."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    sources = numbered(sources, "place", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight).withColumn("cap", F.col("size") * max_epochs))
    total, share = sources.agg(F.sum("size")).first()[0] or 0, 0.0
    while True:  # each round pins at least one more source to its cap, and the level of the others can only rise
        pinned = F.col("cap") <= share * F.col("weight")
        capped, weight_left = sources.agg(F.sum(F.when(pinned, F.col("cap")).otherwise(0)), F.sum(F.when(~pinned, F.col("weight")))).first()
        level = (total - capped) / weight_left if weight_left else share
        if not weight_left or level <= share:
            break
        share = level
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(share) * F.col("weight"))).drop("cap")


def shard_quotas(targets: DataFrame, n_shards: int, block_words: int) -> DataFrame:
    """``source, shard, first_block, blocks``: each output shard's integer quota, and where it starts in the source."""
    weighed = targets.filter("target > 0").withColumn("votes", F.col("target") / block_words)
    n_sources, votes = weighed.agg(F.count("*"), F.sum("votes")).first()
    house = math.floor((votes or 0) + 0.53)  # no half can come up: the targets add up to whole words
    if not house:
        return targets.limit(0).select("source", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("first_block"), F.lit(0).cast("bigint").alias("blocks"))
    cuts = weighed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    cuts = cuts.withColumn("seats", F.floor((F.col("shard") + 1) * house / n_shards))
    # Seat k of a source has the key (2 k + 1) / votes. Up to key x a source holds floor((x votes + 1) / 2) seats, which
    # is within half a seat of x votes / 2: together within S / 2 of x votes / 2 for any x.
    slack = (n_sources + 2) / votes
    middle = F.col("seats") * 2 / F.lit(votes)
    held = lambda x: F.greatest(F.floor((x * F.col("votes") + 1) / 2), F.lit(0))
    cuts = cuts.withColumn("sure", held(middle - slack)).withColumn("open", held(middle + slack))
    seat = cuts.filter("open > sure").withColumn("k", F.explode(F.sequence("sure", F.col("open") - 1)))
    seat = seat.withColumn("key", (2 * F.col("k") + 1) / F.col("votes"))
    sure = cuts.groupBy("shard").agg((F.first("seats") - F.sum("sure")).alias("left"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("key", "place"))
    won = seat.withColumn("rank", rank).join(sure, "shard").filter("rank <= left").groupBy("shard", "place").agg(F.count("*").alias("won"))
    total = cuts.join(won, ["shard", "place"], "left").select(
        "source", "place", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("total"))
    before = F.coalesce(F.lag("total").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    return total.select("source", "shard", before.alias("first_block"), (F.col("total") - before).alias("blocks"))


def _key(source: Column) -> Column:
    """A source as a join key without null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def word_positions(sizes: DataFrame, sources: DataFrame, digits: int = 3) -> DataFrame:
    """``sizes`` with ``first``, the words before each document in its source's seeded order, and the columns of ``sources``.

    Sources are cut into ``16 ** digits`` stretches by the leading digits of the draw, which are even: a source with a
    third of all rows is summed, and met with its own columns, stretch by stretch.
    """
    sizes = sizes.withColumn("key", _key(F.col("source"))).withColumn("stretch", F.substring("draw", 1, digits))
    per_stretch = sizes.groupBy("key", "stretch").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = per_stretch.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    base = base.join(sources.withColumn("key", _key(F.col("source"))).drop("source"), "key")
    inner = Window.partitionBy("key", "stretch").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return within.join(base, ["key", "stretch"]).withColumn("first", F.col("base") + F.col("inner")).drop("base", "inner", "stretch", "key")


def shard_documents(sizes: DataFrame, targets: DataFrame, quotas: DataFrame, block_words: int) -> DataFrame:
    """``shard, source, doc_id, start, words``: the stretches of documents that each shard's blocks take, lap by lap."""
    sized = targets.select("source", F.col("size").alias("source_size"))
    lo, hi = F.col("first_block") * block_words, (F.col("first_block") + F.col("blocks")) * block_words
    runs = quotas.filter("blocks > 0").select(_key(F.col("source")).alias("key"), "shard", lo.alias("lo"), hi.alias("hi"))
    # A source's runs are as many as the shards: one array per source, carried along with its size.
    runs = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "shard"))).alias("runs"))
    sized = sized.withColumn("key", _key(F.col("source"))).join(runs, "key").drop("key")
    met = word_positions(sizes, sized).filter("size > 0").withColumn("run", F.explode("runs")).select("*", "run.*")
    lap = F.explode(F.sequence(F.floor(F.col("lo") / F.col("source_size")), F.floor((F.col("hi") - 1) / F.col("source_size"))))
    met = met.withColumn("lap", lap).withColumn("at", F.col("lap") * F.col("source_size") + F.col("first"))
    start, end = F.greatest("at", "lo"), F.least(F.col("at") + F.col("size"), F.col("hi"))
    return met.filter(start < end).select("shard", "source", "doc_id", (start - F.col("at")).alias("start"), (end - start).alias("words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = 16, n_shards: int = 16,
        seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, blocks``: the words of each document that the mix takes.

    ``blocks`` is the source's total quota. A source whose target is its cap gives no more than the cap, so that its
    last block may be short.
    """
    sizes = document_sizes(docs, seed, doc_id, text, source)
    targets = cut_lineage(source_targets(sizes, weights, max_epochs))
    quotas = shard_quotas(targets, n_shards, block_words).groupBy("source").agg(F.sum("blocks").alias("blocks"))
    quotas = quotas.select(_key(F.col("source")).alias("key"), "blocks")
    sources = targets.withColumn("key", _key(F.col("source"))).join(quotas, "key", "left").select(
        "source", F.col("size").alias("source_size"), "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    words = F.least(F.col("blocks") * block_words, F.col("source_size") * max_epochs)
    laps = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - laps * F.col("source_size")
    taken = F.col("size") * laps + F.least(F.greatest(rest - F.col("first"), F.lit(0)), F.col("size"))
    joined = word_positions(sizes, cut_lineage(sources))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "blocks")
