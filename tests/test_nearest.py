"""k nearest features against brute force: crowds, copies, lonely places, ties."""

import random

import pytest

from waymark.operators import nearest
from waymark.operators.nearest import k_nearest


def clouds():
    draw = random.Random(11)
    rows = [(i, draw.uniform(-170, 170), draw.uniform(-80, 80)) for i in range(120)]  # lonely
    rows += [(i, 10 + draw.random() * 1e-7, 20 + draw.random() * 1e-7) for i in range(200, 500)]  # one crowded place
    rows += [(i, 50.0, 50.0) for i in range(600, 660)] + [(i, float(i % 9), float(i % 7)) for i in range(700, 830)]  # copies and ties
    return rows + [(900, None, 1.0), (901, 1.0, None), (902, -179.0, 89.0)]


def brute(rows, k):
    placed = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for i, x, y in placed:
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b in placed if j != i)[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k,limit", [(1, 32), (5, 8), (70, 4)])
def test_against_brute_force(spark, k, limit):
    df = spark.createDataFrame(clouds(), "fid long, lon double, lat double")
    assert sorted(map(tuple, k_nearest(df, k, limit=limit).collect())) == brute(clouds(), k)


@pytest.mark.parametrize("rows", [[], [(1, 2.0, 3.0)], [(1, 2.0, 3.0), (2, 2.0, 3.0)], [(1, 0.0, 0.0), (2, 0.0, 5.0), (3, 0.0, 9.0)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "fid long, lon double, lat double")
    assert sorted(map(tuple, k_nearest(df, 2).collect())) == brute(rows, 2)


def test_own_leaf_is_compared_at_once(spark):
    """Leaves that go on in the next batch; lists of the place's own leaf alone."""
    rows = [(i, float(i % 5), float(i % 3), i // 20) for i in range(60)]
    tree = spark.createDataFrame(rows, "fid long, x double, y double, cx long").selectExpr(
        "2 AS lv", "cx", "0L AS cy", "x", "y", "array(fid) AS ids", "false AS crowded")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.ids[0]: [tuple(b) for b in r.best] for r in nearest._own_best(tree, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, a, b, d in rows if d == c)[:5] for i, x, y, c in rows}
