"""Labels read from query names, and derived run fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The first word found in the name decides.
DAYS_OF_WORDS = {"FOURTEEN-MONTHS": 392, "TEN-MONTHS": 280, "SIX-MONTHS": 168, "TWO-MONTHS": 56, "TWO-WEEKS": 14, "SIX-DAYS": 6}
TRACK_DAYS = {"5DAY": 5, "1WEEK": 7, "9DAY": 9, "18DAY": 18, "27DAY": 27, "1MONTH": 30}
SIZES_KM = [650, 550, 450, 350, 250, 150, 50, 10]


def _first_word(name: Column, values: dict) -> Column:
    upper, out = F.upper(name), None
    for word, value in values.items():
        test = upper.contains(word)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def days(name: Column) -> Column:
    return _first_word(name, DAYS_OF_WORDS)


def time_words(name: Column) -> Column:
    return _first_word(name, {w: w for w in DAYS_OF_WORDS})


def size_km(name: Column) -> Column:
    """The largest size whose ``N-KM`` the name contains (``150-KM`` also contains ``50-KM``)."""
    return _first_word(name, {f"{s}-KM": s for s in SIZES_KM})


def track_days(name: Column) -> Column:
    return _first_word(name, TRACK_DAYS)


def zoom(name: Column) -> Column:
    """Third token from the end."""
    return F.element_at(F.split(name, "-"), -3).try_cast("int")


def _tokens(name: Column) -> Column:
    return F.split(F.upper(name), "-")


def year(name: Column) -> Column:
    return F.get(_tokens(name), F.lit(7)).try_cast("int")


def month(name: Column) -> Column:
    return F.get(_tokens(name), F.lit(8))


def country(name: Column) -> Column:
    """Everything from the tenth token on; country names may hold dashes."""
    tokens = _tokens(name)
    return F.array_join(F.slice(tokens, F.lit(10), F.greatest(F.size(tokens) - 9, F.lit(0))), "-")


def loose_suffix(name: Column, loose: Column) -> Column:
    return F.concat(name, F.when(loose, "-LOOSE").otherwise(""))


def first_result_delay(first: str = "timeAtFirstResult", start: str = "startTime") -> Column:
    return F.col(first) - F.col(start)


def remaining_time(end: str = "endTime", first: str = "timeAtFirstResult") -> Column:
    return F.col(end) - F.col(first)
