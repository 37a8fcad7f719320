"""Counts of points and box features in box windows, without a row for each feature and window.

The number of points in a box is a sum over its four corners: those below and left of the upper corner, less those below and
left of the others. A box feature meets a box unless it ends before or begins after it, which again is a sum of such counts over
the feature's corners. So all windows become places that ask "how many points have x and y no larger than mine", and a feature
costs a fixed number of rows however many windows it is in.

The question is answered in slices. Points and asked places together are cut into even slices along (x, y), and again along (y, x).
A place counts the points of its own x slice there, those of earlier x slices in its own y slice there, and the rest are whole cells
of the two cuts: the same question on the much smaller table of cells. Equal coordinates do not fill a slice, because both cuts
order by both coordinates and a place is one row. The cuts come from a hash sample and only decide how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from waymark.functions import cells
from waymark.operators.skew import join_measured, salted_join
from waymark.session import cut_lineage

ROWS_PER_SLICE = 400_000
SAMPLES_PER_SLICE = 50
_KEY = ["part", "x", "y"]
_COUNTED = "part int, x double, y double, n bigint"


def _sums_below(x: np.ndarray, y: np.ndarray, n: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each asked place the sum of ``n`` over the points with x <= qx and y <= qy.

    Points lie in the order of y and are split again and again by a bit of their rank in x, so an asked place is a range of rows.
    """
    order = np.argsort(y, kind="stable")
    by_x = np.sort(x)
    rank, weight = np.searchsorted(by_x, x[order]), n[order]
    limit = np.searchsorted(by_x, qx, side="right")  # ranks below it count
    left, right = np.zeros(len(qx), np.int64), np.searchsorted(y[order], qy, side="right")
    total = np.zeros(len(qx), np.int64)
    for bit in reversed(range(len(x).bit_length())):
        zero = rank >> bit & 1 == 0
        zeros = np.concatenate(([0], np.cumsum(zero)))
        sums = np.concatenate(([0], np.cumsum(np.where(zero, weight, 0))))
        ones = limit >> bit & 1 == 1
        total += np.where(ones, sums[right] - sums[left], 0)
        left, right = (np.where(ones, zeros[-1] + at - zeros[at], zeros[at]) for at in (left, right))
        split = np.concatenate((np.flatnonzero(zero), np.flatnonzero(~zero)))
        rank, weight = rank[split], weight[split]
    return total


def _slice_of(first: np.ndarray, second: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of cuts (first, second) that are not above each row."""
    at, end = (np.searchsorted(cuts[0], first, side=s) for s in ("left", "right"))
    open_rows = np.flatnonzero(at < end)
    while len(open_rows):
        open_rows = open_rows[cuts[1][at[open_rows]] <= second[open_rows]]
        at[open_rows] += 1
        open_rows = open_rows[at[open_rows] < end[open_rows]]
    return at


def _cuts(places: DataFrame, slices: dict[int, int], rows_per_slice: int) -> dict[int, tuple]:
    """Per part the cuts along (x, y) and along (y, x); about ``SAMPLES_PER_SLICE`` rows a slice come to the driver."""
    every = max(1, rows_per_slice // SAMPLES_PER_SLICE)
    sample = places.filter(F.col("part").isin(list(slices)) & (F.pmod(F.xxhash64(*_KEY), F.lit(every)) == 0)).select(*_KEY).toPandas()
    out = {}
    for part, count in slices.items():
        rows = sample[sample["part"] == part]
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        at = np.unique(np.arange(1, count) * len(x) // count) if len(x) else np.zeros(0, np.int64)
        out[part] = tuple((a[o][at], b[o][at]) for a, b in ((x, y), (y, x)) for o in [np.lexsort((b, a))])
    return out


def counts_below(points: DataFrame, asked: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``part, x, y, n`` for every distinct asked place: the sum of ``n`` over the points of its part with x and y no larger.

    ``points`` has part, x, y, n and ``asked`` part, x, y, none of them null. Parts are few; each is a world of its own.
    """
    points = points.groupBy(*_KEY).agg(F.sum("n").alias("n"))
    places = cut_lineage(points.unionByName(asked.select(*_KEY).distinct().withColumn("n", F.lit(None).cast("bigint"))))
    sizes = {r["part"]: r["count"] for r in places.groupBy("part").count().collect()}
    # fewer slices than half the root: the table of cells is at most half as large
    slices = {part: s for part, n in sizes.items() if (s := min(-(-n // rows_per_slice), isqrt(n) // 2)) > 1}
    cuts = _cuts(places, slices, rows_per_slice) if slices else {}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
            at = np.zeros((2, len(part)), np.int64)
            for one in cuts:
                rows = np.flatnonzero(part == one)
                at[0, rows] = _slice_of(x[rows], y[rows], cuts[one][0])
                at[1, rows] = _slice_of(y[rows], x[rows], cuts[one][1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[0]), pa.array(at[1])], names=[*batch.schema.names, "sx", "sy"])

    def summed(table: pa.Table, x: str) -> pa.Table:
        known = table.filter(table["n"].is_valid())
        open_rows = table.filter(table["n"].is_null())
        numbers = [known[c].to_numpy() for c in (x, "y", "n")]
        own = open_rows[x].to_numpy() - (1 if x == "sx" else 0)  # slices before the own one
        n = _sums_below(*numbers, own, open_rows["y"].to_numpy())
        return open_rows.select(_KEY).append_column("n", pa.array(n, pa.int64()))

    def in_own(table: pa.Table) -> pa.Table:
        return summed(table, "x")

    def in_earlier(table: pa.Table) -> pa.Table:
        return summed(table, "sx")

    placed = places.mapInArrow(dealt, f"{_COUNTED}, sx bigint, sy bigint")
    found = placed.groupBy("part", "sx").applyInArrow(in_own, _COUNTED)
    if slices:
        cut = placed.filter(F.col("part").isin(list(slices)))
        found = found.unionByName(cut.groupBy("part", "sy").applyInArrow(in_earlier, _COUNTED))
        whole = cut.filter("n IS NOT NULL").groupBy("part", "sx", "sy").agg(F.sum("n").alias("n"))
        open_cells = cut.filter("n IS NULL AND sx > 0 AND sy > 0").select(*_KEY, (F.col("sx") - 1).alias("sx"), (F.col("sy") - 1).alias("sy"))
        as_place = [F.col("part"), F.col("sx").cast("double").alias("x"), F.col("sy").cast("double").alias("y")]
        below = counts_below(whole.select(*as_place, "n"), open_cells.select(*as_place), rows_per_slice)
        below = below.select("part", F.col("x").cast("bigint").alias("sx"), F.col("y").cast("bigint").alias("sy"), "n")
        found = found.unionByName(join_measured(open_cells, below, ["part", "sx", "sy"], ["x", "y"]).select(*_KEY, "n"))
        found = found.groupBy(*_KEY).agg(F.sum("n").alias("n"))
    return found


@F.pandas_udf(DoubleType())
def _just_below(value: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(value.to_numpy(np.float64), -np.inf))


def _sums_at_corners(points: DataFrame, boxes: DataFrame, corners: Sequence[Column], key: str, out: str, rows_per_slice: int) -> DataFrame:
    """``key, out``: the signed sums over the corners (part, x, y, sign) of all boxes of a key; a box below the world has none."""
    asked = cut_lineage(boxes.select(key, F.inline(F.array(*corners))).filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    counts = counts_below(points, asked, rows_per_slice)
    return salted_join(asked, counts, _KEY, [key]).groupBy(key).agg(F.sum(F.col("sign") * F.col("n")).alias(out))


def _corner(part: int | Column, x: Column, y: Column, sign: int) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    return F.struct(part.cast("int").alias("part"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(sign).cast("bigint").alias("sign"))


def _ends(boxes: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Boxes with ends in order, and (before x, before y, x, y): the places just below the lower and at the upper corner."""
    before = [F.when(F.col(c) > F.lit(float("-inf")), _just_below(F.col(c))) for c in ("xmin", "ymin")]
    ordered = boxes.filter((F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")))
    return ordered.withColumns({"_bx": before[0], "_by": before[1]}), [F.col(c) for c in ("_bx", "_by", "xmax", "ymax")]


def points_per_box(
    points: DataFrame, boxes: DataFrame, x: Column, y: Column, key: str = "geom_id", out: str = "n", rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``key, out``: points in the closed boxes (xmin, ymin, xmax, ymax) of each key; keys without boxes in order are left out."""
    rows = points.select(F.lit(0).alias("part"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(1).cast("bigint").alias("n"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    ordered, (bx, by, ux, uy) = _ends(boxes)
    corners = [_corner(0, ux, uy, 1), _corner(0, bx, uy, -1), _corner(0, ux, by, -1), _corner(0, bx, by, 1)]
    return _sums_at_corners(rows, ordered, corners, key, out, rows_per_slice)


def points_per_cover(
    points: DataFrame, boxes: DataFrame, x: Column, y: Column, levels: Sequence[int], key: str = "geom_id", out: str = "n", rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``key, out``: points in the grid cells, at each box's ``level``, that its boxes meet."""
    own = [F.struct(F.lit(lv).alias("part"), cells.cell_x(x, lv).cast("double").alias("x"), cells.cell_y(y, lv).cast("double").alias("y")) for lv in levels]
    rows = points.select(F.inline(F.array(*own))).withColumn("n", F.lit(1).cast("bigint"))
    lv = F.col("level")
    low, high = ([cells.cell_x(F.col(a), lv), cells.cell_y(F.col(b), lv)] for a, b in (("xmin", "ymin"), ("xmax", "ymax")))
    corners = [_corner(lv, *high, 1), _corner(lv, low[0] - 1, high[1], -1), _corner(lv, high[0], low[1] - 1, -1), _corner(lv, low[0] - 1, low[1] - 1, 1)]
    ordered = boxes.filter((F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")))
    return _sums_at_corners(rows, ordered, corners, key, out, rows_per_slice)


def extents_per_box(extents: DataFrame, boxes: DataFrame, key: str = "geom_id", out: str = "n", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``key, out``: box features (xmin, ymin, xmax, ymax) that meet the closed boxes of each key; features with ends out of order meet none."""
    ends = [(0, "xmin", "ymin"), (1, "xmax", "ymin"), (2, "xmin", "ymax"), (3, "xmax", "ymax")]
    ordered = extents.filter((F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")) & ~F.isnan("xmax") & ~F.isnan("ymax"))
    rows = ordered.select(F.inline(F.array(*[F.struct(
        F.lit(part).alias("part"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for part, a, b in ends]))).withColumn("n", F.lit(1).cast("bigint"))
    asked, (bx, by, ux, uy) = _ends(boxes)
    corners = [_corner(0, ux, uy, 1), _corner(1, bx, uy, -1), _corner(2, ux, by, -1), _corner(3, bx, by, 1)]
    return _sums_at_corners(rows, asked, corners, key, out, rows_per_slice)
