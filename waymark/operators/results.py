"""Analytics of run results: comparison of systems, outliers, bins, latency, concurrency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.operators.quantiles import bounded_quantiles, scalar_array
from waymark.operators.skew import attach, join_measured, null_safe_join, running_sum
from waymark.session import cut_lineage


def without_outliers(runs: DataFrame, col: str = "duration") -> DataFrame:
    """Keep values within 1.5 interquartile ranges of the quartiles."""
    q = scalar_array(bounded_quantiles(runs, col, [0.25, 0.75]))
    fenced = runs.withColumn("_q", q)
    q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return fenced.filter(F.col(col).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))).drop("_q")


def mean_by(runs: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def result_range(runs: DataFrame) -> DataFrame:
    return runs.groupBy("queryName").agg(
        F.min("result").alias("min"), F.max("result").alias("max"), F.avg("result").alias("mean"))


def matched_results(runs: DataFrame, systems: Sequence[str] = ("A", "B"), name: str = "queryName") -> DataFrame:
    """Smallest result per name of two systems, inner-merged on the name (one row per name on each side)."""
    own = {s: F.col("system") == s for s in systems}
    per_name = runs.filter(F.col("system").isin(list(systems))).groupBy(name).agg(
        *[F.min(F.when(test, F.col("result"))).alias(f"{s.lower()}_result") for s, test in own.items()],
        *[F.count_if(test).alias(f"_n{i}") for i, test in enumerate(own.values())])
    return per_name.filter((F.col("_n0") > 0) & (F.col("_n1") > 0)).drop("_n0", "_n1")


def mismatches(matched: DataFrame, a: str = "a_result", b: str = "b_result", differ: bool = True) -> DataFrame:
    strict = matched.filter(~F.col("queryName").contains("LOOSE"))
    return strict.filter(F.col(a) != F.col(b)) if differ else strict.filter(F.col(a) == F.col(b))


def chain(runs: DataFrame, slices: Mapping[str, Column], values: Mapping[str, Column]) -> DataFrame:
    """Per name that has rows in every slice the means of each slice, in one pass; columns are ``<slice>_<value>``."""
    tests = list(slices.values())
    means = [F.avg(F.when(test, v)).alias(f"{label}_{out}") for label, test in slices.items() for out, v in values.items()]
    found = runs.groupBy("queryName").agg(*means, *[F.count_if(test).alias(f"_n{i}") for i, test in enumerate(tests)])
    in_all = reduce(Column.__and__, [F.col(f"_n{i}") > 0 for i in range(len(tests))])
    return found.filter(in_all).drop(*[f"_n{i}" for i in range(len(tests))])


def concurrency(runs: DataFrame, by: str = "system") -> DataFrame:
    """``in_flight`` for every run: runs of the same system with ``start <= its start < end``.

    A run without an end goes on; one without a start is in flight nowhere and has null.
    """
    started = runs.filter(F.col("startTime").isNotNull())
    deltas = started.select(by, F.inline(F.array(
        F.struct(F.col("startTime").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col("endTime").alias("t"), F.lit(-1).alias("d"))))).filter(F.col("t").isNotNull())
    net = deltas.groupBy(by, "t").agg(F.sum("d").alias("d"))
    level = running_sum(net, [by], ["t"], "d", "in_flight").select(by, F.col("t").alias("startTime"), "in_flight")
    return null_safe_join(runs, level, [by, "startTime"], "left")


def describe(df: DataFrame, col: str, quantiles: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles, max in one row; ``quantiles`` holds the three quartiles."""
    q = quantiles.select("q").scalar()
    return df.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev(col).alias("std"),
        F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"),
    ).withColumn("_q", q).select(
        "count", "mean", "std", "min", F.get("_q", F.lit(0)).alias("p25"), F.get("_q", F.lit(1)).alias("p50"),
        F.get("_q", F.lit(2)).alias("p75"), "max")


def boxplot(df: DataFrame, by: Sequence[str], col: str = "duration") -> DataFrame:
    """Quartiles and whisker ends per group."""
    q = bounded_quantiles(df, col, [0.25, 0.5, 0.75], by).select(
        *by, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    # whisker ends from the distinct values: one row per group and value, not per run
    values = null_safe_join(df.select(*by, col).distinct(), q, by)
    inside = values.filter(F.col(col).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr))
    return inside.groupBy(*by, "q1", "median", "q3").agg(F.min(col).alias("low"), F.max(col).alias("high"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the largest falls in the last bin."""
    ends = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).alias("e")).scalar()
    at = F.floor((F.col(col) - F.col("_e.lo")) / F.nullif(F.col("_e.hi") - F.col("_e.lo"), F.lit(0.0)) * bins)
    return df.withColumn("_e", ends).select(
        F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def regression(df: DataFrame, by: Sequence[str], y: str = "duration", x: str = "result") -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def predict(df: DataFrame, lines: DataFrame, by: Sequence[str], x: str = "result") -> DataFrame:
    return join_measured(df, lines.select(*by, "slope", "intercept"), by, ["uuid"]).withColumn(
        "predicted", F.col("intercept") + F.col("slope") * F.col(x))


def winners(pairs: DataFrame) -> DataFrame:
    """Per query: the faster system (a tie goes to A) and whether the counts differ (loose names aside)."""
    return pairs.select(
        "queryName", F.when(F.col("b_duration") < F.col("a_duration"), "B").otherwise("A").alias("winner"),
        ((F.col("a_result") != F.col("b_result")) & ~F.col("queryName").contains("LOOSE")).alias("mismatch"))


def slow_requests(runs: DataFrame, limit_ms: int = 10_000) -> DataFrame:
    return runs.filter(F.col("duration") > limit_ms).groupBy("system", "queryName").agg(F.count("*").alias("n"))


def group_values(runs: DataFrame) -> DataFrame:
    """Every run's duration, first-result time and rest, with its group's size and whether counts differ.

    Rows rather than one list per query, so a query run very often stays split.
    """
    groups = runs.groupBy("queryName", "system").agg(
        F.count("*").alias("n"), (F.min("result") != F.max("result")).alias("differs"))
    return join_measured(runs, groups, ["queryName", "system"], ["uuid"]).select(
        "queryName", "system", "duration", (F.col("timeAtFirstResult") - F.col("startTime")).alias("first"),
        (F.col("endTime") - F.col("timeAtFirstResult")).alias("rest"), "n", "differs")


def latency_summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, min, max, mean, std, p50, p75, p95, p99 and requests per second."""
    q = bounded_quantiles(runs, "duration", [0.5, 0.75, 0.95, 0.99], by)
    seconds = F.nullif((F.max("endTime") - F.min("startTime")) / 1000.0, F.lit(0.0))  # a group of one instant has no rate
    base = runs.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("duration").alias("min"), F.max("duration").alias("max"), F.avg("duration").alias("mean"),
        F.stddev_pop("duration").alias("std"), (F.count("*") / seconds).alias("per_second"))
    return null_safe_join(base, q, by, "left").select(
        *by, "n", "min", "max", "mean", "std", *[F.get("q", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p75", "p95", "p99"))],
        "per_second")


def latency_bands(runs: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """Shares below 800 ms, to 1200 ms, above, and failed."""
    d, n = F.col("duration"), F.count("*")
    share = lambda test: F.count_if(test) / n
    return runs.groupBy(*by).agg(
        share(ok & (d < 800)).alias("fast"), share(ok & d.between(800, 1200)).alias("middle"),
        share(ok & (d > 1200)).alias("slow"), share(~ok).alias("failed"))


def requests_by_key(runs: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """OK and KO counts per key combination, per first key, and over all (null keys)."""
    return runs.rollup(*keys).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("ko"))


def without_warmup(repeats: DataFrame, by: str, order: str) -> DataFrame:
    """Drop the first repeat of each measurement, without ordering a group in one task."""
    first = repeats.groupBy(by).agg(F.min(order).alias("_first"))
    return join_measured(repeats, first, [by], [order]).filter(F.col(order) > F.col("_first")).drop("_first")


def numbered_pairs(df: DataFrame, columns: Sequence[str], out: str = "group") -> DataFrame:
    """Number the distinct label combinations from 0 in order, null last, and join the number back.

    The window runs over the distinct labels only, which the label lists bound.
    """
    labels = df.select(*columns).distinct()
    order = Window.orderBy(*[F.col(c).asc_nulls_last() for c in columns])
    return attach(df, cut_lineage(labels.withColumn(out, F.dense_rank().over(order) - 1)), columns, "inner")
