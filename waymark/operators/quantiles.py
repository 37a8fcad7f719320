"""Exact quantiles with linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.operators.skew import ROWS_PER_TASK, attach, running_sum
from waymark.session import cut_lineage

CUTS = 64  # buckets of the ungrouped form
GROUP_CUTS = 16  # and per group
DISTINCT_IN_TASK = 1_000_000


def _bucket(cuts: Sequence[float], first: int = 0) -> str:
    """Number of cut points below ``_v``, as a search tree of literals (compiled, unlike a lambda)."""
    if not cuts:
        return str(first)
    middle = len(cuts) // 2
    above, below = _bucket(cuts[middle + 1:], first + middle + 1), _bucket(cuts[:middle], first)
    return f"CASE WHEN _v > {cuts[middle]!r}D THEN {above} ELSE {below} END"


def bounded_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), most: int = DISTINCT_IN_TASK) -> DataFrame:
    """``by.., q``: quantile array of a column that usually has few distinct values per group, as run durations have.

    Equal values are counted first. The aggregation holds one entry per distinct value of a group in one task; groups
    with more than ``most`` of them take the distributed selection, which gives the same numbers.
    """
    counted = cut_lineage(df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_f")))
    largest = counted.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        return exact_quantiles(df, col, probs, by)
    return counted.groupBy(*by).agg(F.percentile(col, F.array(*[F.lit(float(p)) for p in probs]), F.col("_f")).alias("q"))


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The same for any column and size, as a distributed selection in three passes over the data.

    Approximate cut points split every group in buckets; bucket counts tell which buckets hold the wanted
    ranks; only these are ordered, with equal values counted first and large buckets split further.
    """
    groups, by = list(by), ["_by"] if by else []  # one struct: null groups are groups like others
    v = F.col(col).cast("double")
    rows = df.filter(F.col(col).isNotNull()).select(*[F.struct(*groups).alias("_by") for _ in by], v.alias("_v"))
    n_cuts = GROUP_CUTS if by else CUTS
    cut_probs = F.array(*[F.lit(i / n_cuts) for i in range(1, n_cuts)])
    sketch = cut_lineage(rows.groupBy(*by).agg(F.percentile_approx("_v", cut_probs, 10 * n_cuts).alias("_cuts"), F.count("*").alias("_total")))
    if by:
        # one row per group and at most GROUP_CUTS numbers each
        side = F.broadcast(sketch) if sketch.count() <= 100_000 else sketch
        bucketed = rows.join(side, by).select(*by, "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))
    else:
        cuts = sorted(set(sketch.first()["_cuts"] or []))  # at most CUTS numbers
        bucketed = rows.select("_v", F.expr(_bucket(cuts)).alias("_b"))

    sizes = bucketed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    # at most CUTS rows per group from here
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    spans = sizes.withColumn("_last", F.sum("_n").over(upto)).withColumn("_first", F.col("_last") - F.col("_n"))
    numbers = ", ".join(f"{float(p)!r}D" for p in probs)
    asked = sketch.select(*by, "_total", F.posexplode(F.expr(f"array({numbers})")).alias("i", "p")).withColumn(
        "at", F.col("p") * (F.col("_total") - 1))
    wanted = asked.select(*by, "i", (F.col("at") - F.floor("at")).alias("part"), F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("rank")))))
    # one wanted rank meets the at most CUTS buckets of its own group
    one = ["_one"]
    key = by or one
    spans_k = spans if by else spans.withColumn("_one", F.lit(1))
    wanted_k = wanted if by else wanted.withColumn("_one", F.lit(1))
    targets = cut_lineage(wanted_k.join(spans_k, key).filter((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_last"))).select(
        *by, "_b", "i", "side", "part", (F.col("rank") - F.col("_first")).alias("_r")))
    needed = targets.select(*by, "_b").distinct()
    values = cut_lineage(bucketed.join(needed, [*by, "_b"], "left_semi").groupBy(*by, "_b", "_v").agg(F.count("*").alias("_f")))
    placed = running_sum(values, [*by, "_b"], ["_v"], "_f", "_upto", rows_per_task)
    picked = placed.join(targets, [*by, "_b"]).filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_f")))
    pairs = picked.groupBy(*by, "i").agg(
        F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("hi"),
        F.max("part").alias("part"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    collected = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("_q"))
    return collected.select(*[F.col(f"_by.{g}") for g in groups], F.transform("_q", lambda x: x["v"]).alias("q"))


def with_bins(df: DataFrame, col: str, n: int, by: Sequence[str] = (), out: str = "range_group", duplicates: str = "raise") -> DataFrame:
    """Number the quantile bin of ``col``: right-closed, the lowest value in bin 0, with the ``edges``.

    Equal edges are an error, or with ``duplicates="drop"`` count once. A null value is in no bin; null groups have
    bins of their own.
    """
    by = list(by)
    edges = exact_quantiles(df, col, [i / n for i in range(n + 1)], by).withColumnRenamed("q", "edges")
    distinct = F.array_distinct("edges")
    if duplicates == "drop":
        edges = edges.withColumn("edges", distinct)
    else:
        edges = edges.withColumn("edges", F.when(F.size(distinct) == F.size("edges"), F.col("edges")).otherwise(
            F.raise_error(F.lit(f"bin edges of {col} are not unique")).cast("array<double>")))
    both = attach(df, cut_lineage(edges), by) if by else df.withColumn("edges", edges.scalar())
    inner = F.slice("edges", F.lit(2), F.size("edges") - 2)
    return both.withColumn(out, F.when(F.col(col).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(col)))))


def scalar_array(quantiles: DataFrame) -> Column:
    """The quantile array of the ungrouped forms as a scalar subquery."""
    return quantiles.select("q").scalar()
