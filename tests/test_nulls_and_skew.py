"""Null labels, groups and keys lose nothing, and hot keys are cut evenly."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.clusters import convex_hulls
from waymark.operators.quantiles import bounded_quantiles, exact_quantiles, with_bins
from waymark.operators.results import numbered_pairs
from waymark.operators.skew import lead_in_key, running_sum, salted_join, with_chunks
from waymark.sources.layout import joined_ranges


def test_bins_of_null_values_and_groups(spark):
    rows = [(i, g, float(i) if i % 5 else None) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = with_bins(df, "v", 4, ["g"]).collect()
    assert len(got) == len(rows)
    assert all((r.range_group is None) == (r.v is None) for r in got)
    assert Counter(r.range_group for r in got if r.g is None) == Counter(r.range_group for r in got if r.g == "a")
    alone = with_bins(df.filter("g is null"), "v", 4).collect()
    assert Counter((r.id, r.range_group) for r in alone) == Counter((r.id, r.range_group) for r in got if r.g is None)
    only = spark.createDataFrame([(1, "x", None)], "id long, g string, v double")
    assert with_bins(only, "v", 4, ["g"]).first().range_group is None
    assert {r.g for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()} == {"a", None}


def test_numbers_of_null_labels(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "a", 1), (4, None, None), (5, "a", None)], "id int, s string, d int")
    assert {r.id: r.group for r in numbered_pairs(df, ["s", "d"]).collect()} == {3: 0, 1: 1, 5: 1, 2: 2, 4: 3}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_hull_of_the_null_group(spark, kind):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0), (1.0, 3.0)]
    df = spark.createDataFrame([(g, x, y) for g in (7, None) for x, y in square], "g int, lon double, lat double").withColumn("g", F.col("g").cast(kind))
    got = convex_hulls(df, "g")
    assert dict(got.dtypes)["g"] == kind
    corners = {(r.g, r.x, r.y) for r in got.collect()}
    seven = 7 if kind == "int" else "7"
    assert corners == {(g, x, y) for g in (seven, None) for x, y in square[:4]}


@pytest.fixture(scope="module")
def hot(spark):
    """One null key and one key with an outlier, both hot, in fractions below 1; and a cold key."""
    rows = [(None, i / 1000) for i in range(1000)] + [("o", i / 1000) for i in range(999)] + [("o", 1e9)] + [("c", i / 10) for i in range(20)]
    return spark.createDataFrame(rows, "k string, t double").withColumn("id", F.monotonically_increasing_id())


def test_chunks_are_even(hot):
    sizes = {(r.k, r._chunk): r["count"] for r in with_chunks(hot, ["k"], "t", 50).groupBy("k", "_chunk").count().collect()}
    assert sum(sizes.values()) == hot.count() and max(sizes.values()) <= 110
    assert sum(k is None for k, _ in sizes) >= 15 and sum(k == "c" for k, _ in sizes) == 1


def test_chunked_windows_agree(hot):
    order = ["t", "id"]
    for f in (lambda n: lead_in_key(hot, ["k"], order, ["t"], "out", n), lambda n: running_sum(hot, ["k"], order, "t", "out", n)):
        one, cut = ({(r.k, r.id): r.out for r in f(n).collect()} for n in (10 ** 9, 50))
        assert set(one) == set(cut)
        for key, value in one.items():
            assert cut[key] == (pytest.approx(value) if isinstance(value, float) else value)


def test_salted_join_spreads_null_keys(spark, hot):
    other = spark.createDataFrame([("o", 1), ("c", 2), (None, 3)], "k string, n int")
    kept = salted_join(hot, other, ["k"], ["id"], "left", 50)
    assert kept.count() == hot.count() and kept.filter("k is null and n is null").count() == 1000
    assert salted_join(hot, other, ["k"], ["id"], "inner", 50).count() == 1020


def test_points_near_the_pole_stay_apart(spark):
    row = spark.range(1).select(geo.within_metres(F.lit(10.0), F.lit(89.0), *[F.lit(v) for v in (*geo.merc_xy(10.0, 86.0), 1.0)]).alias("near")).first()
    assert not row.near


def test_bounded_and_distributed_quantiles_agree(spark):
    df = spark.createDataFrame([(g, float((i * 37) % 101)) for g in ("a", "b", None) for i in range(150)], "g string, v double")
    one, other = ({r.g: r.q for r in bounded_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99], ["g"], most).collect()} for most in (1000, 10))
    assert one.keys() == other.keys() == {"a", "b", None}
    assert all(one[g] == pytest.approx(other[g]) for g in one)


def test_curve_ranges_are_joined_at_the_smallest_gaps():
    ranges = [(0, 1), (3, 4), (10, 11), (12, 13), (40, 50)]
    assert joined_ranges(ranges, 3) == [(0, 4), (10, 13), (40, 50)]
    assert joined_ranges(ranges, 5) == ranges and joined_ranges(ranges, 1) == [(0, 50)]


def test_merges_keep_null_keys(spark):
    from waymark.operators import results
    rows = [(f"u{i}", ("A", "B", None)[i % 3], None if i % 4 == 0 else "q", i * 10, i * 10 + 25, i, i * 10 + 5, i) for i in range(30)]
    runs = spark.createDataFrame(rows, "uuid string, system string, queryName string, startTime long, endTime long, duration long, timeAtFirstResult long, result long")
    flying = {r.uuid: r.in_flight for r in results.concurrency(runs).collect()}
    assert flying == {u: sum(s == t and a <= c < b for _, t, _, a, b, *_ in rows) for u, s, _, c, *_ in rows}
    no_start = results.concurrency(runs.withColumn("startTime", F.when(F.col("uuid") != "u3", F.col("startTime")))).collect()
    assert len(no_start) == 30 and [r.uuid for r in no_start if r.in_flight is None] == ["u3"]
    assert results.group_values(runs).count() == 30
    assert {r.system for r in results.boxplot(runs, ["system"]).collect()} == {"A", "B", None} == {r.system for r in results.latency_summary(runs, ["system"]).collect()}
    assert results.predict(runs, results.regression(runs, ["system"]), ["system"]).filter("predicted is not null").count() == 30
    assert results.without_warmup(runs, "system", "startTime").count() == 27
    assert {r.queryName for r in results.matched_results(runs).collect()} == {"q", None}


@pytest.mark.parametrize("rows_per_task", [5, 10 ** 6])
def test_salted_join_of_null_keys(spark, rows_per_task):
    big = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id int, k string")
    small = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert salted_join(big, small, ["k"], ["id"], rows_per_task=rows_per_task, null_safe=True).groupBy("v").count().orderBy("v").collect() == [(1, 20), (2, 20)]
    assert salted_join(big, small, ["k"], ["id"], rows_per_task=rows_per_task).count() == 20
