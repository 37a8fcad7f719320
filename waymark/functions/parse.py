"""Field functions of the column mapping: text fields to typed feature attributes.

``on_bad="null"`` gives null for a value that does not parse; ``on_bad="sentinel"`` gives the fixed
values below.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a value that does not parse becomes in sentinel mode. The date is epoch -1 ms.
BAD_INT = -2147483648
BAD_DOUBLE = float("nan")
BAD_POINT = (0.0, 0.0)
BAD_DATE = "1969-12-31 23:59:59.999"

POINT_TYPE = "struct<lon:double,lat:double>"


def _or_bad(value: Column, bad: Column, on_bad: str) -> Column:
    if on_bad not in ("null", "sentinel"):
        raise ValueError("on_bad is 'null' or 'sentinel'")
    return F.coalesce(value, bad) if on_bad == "sentinel" else value


def to_int(text: Column, on_bad: str = "null") -> Column:
    return _or_bad(text.try_cast("int"), F.lit(BAD_INT), on_bad)


def to_double(text: Column, on_bad: str = "null") -> Column:
    return _or_bad(text.try_cast("double"), F.lit(BAD_DOUBLE), on_bad)


def to_point(x: Column, y: Column, on_bad: str = "null") -> Column:
    """Point struct; both numbers parse or neither counts."""
    lon, lat = x.try_cast("double"), y.try_cast("double")
    point = F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))
    bad = F.struct(F.lit(BAD_POINT[0]).alias("lon"), F.lit(BAD_POINT[1]).alias("lat"))
    return _or_bad(point, bad, on_bad)


def to_date(text: Column, pattern: str, on_bad: str = "null") -> Column:
    """Strict pattern: month 13 is a bad value, it does not roll over into the next year."""
    return _or_bad(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"), F.lit(BAD_DATE).cast("timestamp_ntz"), on_bad)


def concat(*texts: Column) -> Column:
    return F.concat(*[F.coalesce(t, F.lit("")) for t in texts])


def literal(text: str) -> Column:
    return F.lit(text)


class Fields:
    """The fields of one line; ``f[n]`` is the n-th field counted from 1, null past the end."""

    def __init__(self, array: Column):
        self._array = array

    def __getitem__(self, n: int) -> Column:
        return F.get(self._array, F.lit(n - 1))
