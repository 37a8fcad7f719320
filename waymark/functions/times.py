"""Time windows and time predicates."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class TimeSpan(NamedTuple):
    """Two optional ends; ``closed`` says whether the ends themselves belong to the span."""

    lo: datetime | None = None
    hi: datetime | None = None
    closed: bool = False


ALL_TIME = TimeSpan()


def _parse(value: str | datetime | None) -> datetime | None:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def during(start, end, minus_seconds: int = 1, closed: bool = False) -> TimeSpan:
    """``start < t < end - 1 s``. Ends that meet after the subtraction mean the instant itself."""
    lo, hi = _parse(start), _parse(end) - timedelta(seconds=minus_seconds)
    return TimeSpan(lo, hi, closed or lo == hi)


def between(start, end) -> TimeSpan:
    """``start <= t <= end``, nothing taken off the end."""
    return TimeSpan(_parse(start), _parse(end), True)


def at(instant) -> TimeSpan:
    return TimeSpan(_parse(instant), _parse(instant), True)


def after(start) -> TimeSpan:
    return TimeSpan(_parse(start), None)


def before(end, minus_seconds: int = 1) -> TimeSpan:
    return TimeSpan(None, _parse(end) - timedelta(seconds=minus_seconds))


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_span(ts: Column, span: TimeSpan) -> Column:
    """Literal comparisons only, so the filter reaches the Parquet scan."""
    test = ts.isNotNull()
    if span.lo is not None and span.lo == span.hi:
        return ts == ntz(span.lo)
    if span.lo is not None:
        test = test & ((ts >= ntz(span.lo)) if span.closed else (ts > ntz(span.lo)))
    if span.hi is not None:
        test = test & ((ts <= ntz(span.hi)) if span.closed else (ts < ntz(span.hi)))
    return test


def in_span_columns(ts: Column, lo: Column, hi: Column, closed: Column) -> Column:
    """The same with the ends held in columns of a window table."""
    return (
        (lo.isNull() | (ts > lo) | (closed & (ts == lo)))
        & (hi.isNull() | (ts < hi) | (closed & (ts == hi)))
    )
