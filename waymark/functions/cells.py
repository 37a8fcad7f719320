"""Grid cells and curve keys over the lon/lat world.

At ``bits`` b the world is split in 2^b columns and 2^b rows. A cell number is ``floor`` of a monotone
expression, so a point inside a closed box always falls in a cell between the cells of its corners.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MAX_LEVEL = 20
_Y_SHIFT = 24  # key = level * 2^48 + column * 2^24 + row


def _axis_cell(value: Column, low: float, span: float, bits: int | Column) -> Column:
    n = F.lit(float(2**bits)) if isinstance(bits, int) else F.pow(F.lit(2.0), bits)
    cell = F.floor((value - F.lit(low)) / F.lit(span) * n)
    return F.greatest(F.lit(0).cast("long"), F.least(cell, (n - 1).cast("long")))


def cell_x(lon: Column, bits: int | Column) -> Column:
    return _axis_cell(lon, -180.0, 360.0, bits)


def cell_y(lat: Column, bits: int | Column) -> Column:
    return _axis_cell(lat, -90.0, 180.0, bits)


def cell_key(level: int | Column, cx: Column, cy: Column) -> Column:
    base = F.lit(level * 2**48) if isinstance(level, int) else level.cast("long") * F.lit(2**48)
    return base + cx * F.lit(2**_Y_SHIFT) + cy


def point_key(lon: Column, lat: Column, level: int | Column) -> Column:
    return cell_key(level, cell_x(lon, level), cell_y(lat, level))


def level_for(width: float, height: float, per_axis: int = 8) -> int:
    """Finest even level at which a box spans about ``per_axis`` cells at most."""
    fit = min(360.0 / width if width > 0 else math.inf, 180.0 / height if height > 0 else math.inf)
    if math.isinf(fit):
        return MAX_LEVEL
    level = math.floor(math.log2(max(1.0, fit * per_axis)))
    return max(0, min(MAX_LEVEL, level // 2 * 2))


def level_expr(width: Column, height: Column, per_axis: int = 8) -> Column:
    """:func:`level_for` as an expression for window tables that are themselves data."""
    fit = F.least(F.lit(360.0) / F.greatest(width, F.lit(1e-9)), F.lit(180.0) / F.greatest(height, F.lit(1e-9)))
    level = F.floor(F.log2(F.greatest(F.lit(1.0), fit * per_axis)) / 2) * 2
    return F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), level)).cast("int")


def box_cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, level: int | Column) -> Column:
    """Array of ``struct<cx, cy>`` of all cells a box meets."""
    rows = F.sequence(cell_y(ymin, level), cell_y(ymax, level))
    cols = F.sequence(cell_x(xmin, level), cell_x(xmax, level))
    return F.flatten(F.transform(cols, lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def n_box_cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, level: int | Column) -> Column:
    return (cell_x(xmax, level) - cell_x(xmin, level) + 1) * (cell_y(ymax, level) - cell_y(ymin, level) + 1)


# Shift and mask pairs that spread the bits of a number one or two places apart.
SPREAD_BY_2 = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
               (2, 0x3333333333333333), (1, 0x5555555555555555))
SPREAD_BY_3 = ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F),
               (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _spread(value: Column, steps) -> Column:
    for shift, mask in steps:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def z2(lon: Column, lat: Column, bits: int = 31) -> Column:
    """Morton key of 2 * bits bits."""
    return _spread(cell_x(lon, bits), SPREAD_BY_2).bitwiseOR(
        F.shiftleft(_spread(cell_y(lat, bits), SPREAD_BY_2), 1))


PERIOD_SECONDS = {"day": 86400, "week": 604800}  # month and year are calendar periods


def period_number(ts: Column, period: str) -> Column:
    """Running number of the day, week, month or year since 1970."""
    if period in PERIOD_SECONDS:
        return F.floor(unix_seconds(ts) / F.lit(float(PERIOD_SECONDS[period]))).cast("long")
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    if period == "month":
        return months.cast("long")
    if period == "year":
        return (F.year(ts) - 1970).cast("long")
    raise ValueError(f"unknown period {period}")


def unix_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ (the session zone is UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def unix_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def z3(lon: Column, lat: Column, ts: Column, period: str = "week") -> Column:
    """Morton key of 21 + 21 + 20 bits: space and the second within the period.

    Month and year periods have more than 2^20 seconds; their offset is scaled to 20 bits.
    """
    if period in PERIOD_SECONDS:
        offset = F.pmod(unix_seconds(ts), F.lit(PERIOD_SECONDS[period]))
    else:
        longest = 31 * 86400 if period == "month" else 366 * 86400
        start = F.date_trunc(period, ts).cast("timestamp_ntz")
        offset = F.floor((unix_seconds(ts) - unix_seconds(start)) * F.lit(float(2**20)) / F.lit(float(longest)))
    return (
        _spread(cell_x(lon, 21), SPREAD_BY_3)
        .bitwiseOR(F.shiftleft(_spread(cell_y(lat, 21), SPREAD_BY_3), 1))
        .bitwiseOR(F.shiftleft(_spread(offset.cast("long"), SPREAD_BY_3), 2))
    )


def _z_of_cell(cx: int, cy: int) -> int:
    return sum(((cx >> i & 1) << (2 * i)) | ((cy >> i & 1) << (2 * i + 1)) for i in range(31))


def cover(box: tuple[float, float, float, float], bits: int = 6, key_bits: int = 31) -> list[tuple[int, int]]:
    """Closed ranges of ``z2`` keys that cover a box, from its cells at a coarse level."""
    def axis(v: float, low: float, span: float) -> int:
        return max(0, min(2**bits - 1, math.floor((v - low) / span * 2**bits)))
    xs = range(axis(box[0], -180.0, 360.0), axis(box[2], -180.0, 360.0) + 1)
    ys = range(axis(box[1], -90.0, 180.0), axis(box[3], -90.0, 180.0) + 1)
    width = 4 ** (key_bits - bits)
    ranges: list[tuple[int, int]] = []
    for z in sorted(_z_of_cell(cx, cy) for cx in xs for cy in ys):
        if ranges and ranges[-1][1] + 1 == z * width:
            ranges[-1] = (ranges[-1][0], (z + 1) * width - 1)
        else:
            ranges.append((z * width, (z + 1) * width - 1))
    return ranges
