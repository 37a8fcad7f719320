"""Joins and ordered computations that stay split when one key holds a large share of the rows.

Every helper first counts rows per key (partial aggregation, one small row per key leaves a task) and
keeps only the keys above ``rows_per_task``. There can be at most ``total rows / rows_per_task`` of
them, so that table is safe to broadcast at any data size. The count runs when the plan is built: without
hot keys the plan stays the plain join or window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.cells import unix_millis
from waymark.session import cut_lineage

ROWS_PER_TASK = 2_000_000
BROADCAST_ROWS = 200_000
MAX_SLICES = 1000  # of one key


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a written table on keys that may be null; it is broadcast if its row count is within the limit."""
    return null_safe_join(big, F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the key columns are those of ``left``."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    test = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, test, how).drop(*[f"_k{i}" for i in range(len(keys))])


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Keys above the limit with the number of parts each is split in; None if there are none."""
    hot = cut_lineage(
        df.groupBy(*keys).agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts"))
    )
    return None if hot.isEmpty() else hot


def salted_join(
    big: DataFrame, other: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    how: str = "inner", rows_per_task: int = ROWS_PER_TASK, *, null_safe: bool = False,
) -> DataFrame:
    """Equi-join that splits hot keys of ``big``, null among them, and repeats only the matching rows of ``other``.

    With ``null_safe`` null keys meet null keys, else nothing. ``spread_by`` are columns of ``big`` that differ between its rows (a feature id); the split is a
    hash of them, so a task run again after a lost executor makes the same split.
    """
    found = None if big.isStreaming else hot_keys(big, keys, rows_per_task)
    join = null_safe_join if null_safe else lambda left, right, on, how: left.join(right, list(on), how)
    if found is None:
        return join(big, other, keys, how)
    left = attach(big, found, keys).withColumn(
        "_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int"))
    ).drop("_parts")
    right = attach(other, found, keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    ).drop("_parts")
    return join(left, right, [*keys, "_salt"], how).drop("_salt")


def join_measured(
    big: DataFrame, other: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner",
    max_rows: int = 200_000,
) -> DataFrame:
    """Join with a side that is usually small: it is worked out first, broadcast if its row count is within
    the limit, and otherwise joined with hot keys split. Null keys meet null keys."""
    other = cut_lineage(other)
    if other.count() <= max_rows:
        return null_safe_join(big, F.broadcast(other), keys, how)
    return salted_join(big, other, keys, spread_by, how, null_safe=True)


def _as_number(df: DataFrame, column: str) -> Column:
    if dict(df.dtypes)[column].startswith("timestamp"):
        return unix_millis(F.col(column))
    return F.col(column)


def with_chunks(df: DataFrame, keys: Sequence[str], order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Add ``_chunk``: 0 for ordinary keys, a slice number along ``order`` for hot keys, and ``_hot``.

    Slices end at approximate quantiles of the hot key's own rows, so that outliers and uneven times leave them even;
    rows of one value stay in one slice. None if no key is hot.
    """
    hot = hot_keys(df, keys, rows_per_task)
    if hot is None:
        return None
    position = _as_number(df, order)
    slices = min(MAX_SLICES, hot.agg(F.max("_parts")).first()[0])
    cuts = F.percentile_approx(position, F.array(*[F.lit(i / slices) for i in range(1, slices)]), max(10_000, 10 * slices))
    found = cut_lineage(attach(df, hot.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts")))
    slice_no = F.size(F.filter("_cuts", lambda c: c < position))
    return (
        attach(df, found, keys).withColumn("_hot", F.col("_cuts").isNotNull())
        .withColumn("_chunk", F.when(F.col("_hot"), slice_no).otherwise(0).cast("long")).drop("_cuts")
    )


def lead_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Struct ``out`` with the ``take`` columns of the next row of the same key (null for the last).

    ``order[0]`` is the time or number the rows run along. Within a chunk of a hot key this is ``lead``; the
    last row of a chunk takes the first row of the key's next chunk.
    """
    nxt = F.struct(*take)
    chunked = with_chunks(df, keys, order[0], rows_per_task)
    if chunked is None:
        return df.withColumn(out, F.lead(nxt).over(Window.partitionBy(*keys).orderBy(*order)))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    led = chunked.withColumn("_lead", F.lead(nxt).over(within))
    heads = (
        chunked.filter("_hot").groupBy(*keys, "_chunk")
        .agg(F.min_by(nxt, F.struct(*order)).alias("_head"))
        .withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_head")
    )
    return (
        attach(led, cut_lineage(heads), [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_lead", "_next_head"))
        .drop("_chunk", "_hot", "_lead", "_next_head")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sum of ``value`` over this and all earlier rows of the key, in two levels for hot keys."""
    chunked = with_chunks(df, keys, order[0], rows_per_task)
    if chunked is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(upto))
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.filter("_hot").groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(before)).drop("_sum")
    )
    return (
        attach(chunked.withColumn(out, F.sum(value).over(within)), cut_lineage(offsets), [*keys, "_chunk"])
        .withColumn(out, F.col(out) + F.coalesce("_offset", F.lit(0)))
        .drop("_chunk", "_hot", "_offset")
    )
