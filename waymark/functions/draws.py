"""Repeatable random draws.

A draw is a hash of (seed, stream, row key), so it does not depend on how rows are spread over tasks and
a task run again after a lost executor draws the same numbers. ``F.rand`` has neither property once the
input partitioning changes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_SCALE = float(2**52)


def _digest(seed, stream: str, *keys: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), F.lit(stream), *[k.cast("string") for k in keys]))


def unit(seed, stream: str, *keys: Column) -> Column:
    """Uniform in [0, 1) with 52 bits."""
    return F.conv(F.substring(_digest(seed, stream, *keys), 1, 13), 16, 10).cast("long") / F.lit(_SCALE)


def uniform(seed, stream: str, low, high, *keys: Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return low + unit(seed, stream, *keys) * (high - low)


def normal(seed, stream: str, mean, sigma, *keys: Column) -> Column:
    mean, sigma = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, sigma))
    u1, u2 = unit(seed, stream + "/a", *keys), unit(seed, stream + "/b", *keys)
    g = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return mean + g * sigma


def letters(seed, stream: str, length: int, *keys: Column) -> Column:
    """Random A-Z string; eight letters come from one digest."""
    out = []
    for i in range(length):
        digest = _digest(seed, f"{stream}/{i // 8}", *keys)
        number = F.conv(F.substring(digest, i % 8 * 4 + 1, 4), 16, 10).cast("int")
        out.append(F.char((number % 26 + 65).cast("long")))
    return F.concat(*out)


def draw(description: tuple, seed, stream: str, *keys: Column) -> Column:
    """A distribution as data: ``("uniform", a, b)``, ``("normal", mean, sigma)`` or ``("fixed", x)``."""
    kind, *args = description
    if kind == "uniform":
        return uniform(seed, stream, *args, *keys)
    if kind == "normal":
        return normal(seed, stream, *args, *keys)
    if kind == "fixed":
        return args[0] if isinstance(args[0], Column) else F.lit(float(args[0]))
    raise ValueError(f"expected uniform, normal or fixed, found {kind}")


def unit_sql(seed, stream: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}|{stream}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)/4503599627370496e0)"


def normal_sql(seed, stream: str, *keys: str) -> str:
    return (f"(sqrt(-2e0*ln(1e0-{unit_sql(seed, stream + '/a', *keys)}))*cos({2 * math.pi!r}*{unit_sql(seed, stream + '/b', *keys)}))")


def letters_sql(seed, stream: str, length: int, *keys: str) -> str:
    parts = []
    for i in range(length):
        text = " || '|' || ".join([f"'{seed}|{stream}/{i // 8}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
        parts.append(f"chr(CAST(CAST(('0x' || substr(md5({text}), {i % 8 * 4 + 1}, 4)) AS BIGINT) % 26 + 65 AS INTEGER))")
    return "(" + " || ".join(parts) + ")"
