"""Joins that split hot keys, quantiles, nearness, clusters and streams against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import clusters, process, quantiles, results
from waymark.operators.skew import lead_in_key, running_sum, salted_join
from waymark.streaming import jobs


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 400), i, rng.randint(1, 9)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, t long, id long, v long")


@pytest.mark.parametrize("limit", [10_000, 25])
def test_lead_and_running_sum(events, limit):
    rows, df = events
    led = {r.id: (r.n.id if r.n else None) for r in lead_in_key(df, ["k"], ["t", "id"], ["id"], "n", limit).collect()}
    summed = {r.id: r.s for r in running_sum(df, ["k"], ["t", "id"], "v", "s", limit).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        total = 0
        for i, r in enumerate(own):
            total += r[3]
            assert led[r[2]] == (own[i + 1][2] if i + 1 < len(own) else None)
            assert summed[r[2]] == total


@pytest.mark.parametrize("limit", [10_000, 25])
def test_salted_join_keeps_every_pair(spark, events, limit):
    rows, df = events
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, w int")
    got = sorted((r.id, r.w) for r in salted_join(df, other, ["k"], ["id"], rows_per_task=limit).collect())
    assert got == sorted((r[2], w) for r in rows for k, w in [("hot", 1), ("hot", 2), ("k1", 3)] if r[0] == k)


@pytest.mark.parametrize("limit", [10_000, 20])
def test_exact_quantiles(spark, limit):
    rng = np.random.default_rng(4)
    data = {"a": np.round(rng.normal(size=500), 2), "b": rng.random(31), "one": np.array([7.0]), "same": np.full(40, 2.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for r in quantiles.exact_quantiles(df, "v", probs, ["g"], limit).collect():
        assert np.allclose(r.q, np.quantile(data[r.g], probs)), r.g
    every = np.concatenate(list(data.values()))
    assert np.allclose(quantiles.exact_quantiles(df, "v", probs, (), limit).first().q, np.quantile(every, probs))
    assert np.allclose(quantiles.bounded_quantiles(df, "v", probs).first().q, np.quantile(every, probs))


def test_bins_like_pandas(spark):
    import pandas as pd
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 12]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    got = [r.range_group for r in quantiles.with_bins(df, "v", 4).orderBy("i").collect()]
    assert got == list(pd.qcut(pd.Series(values), 4, labels=False))
    same = spark.createDataFrame([(1,)] * 9 + [(5,)], "v int")
    with pytest.raises(Exception, match="not unique"):
        quantiles.with_bins(same, "v", 4).collect()
    assert quantiles.with_bins(same, "v", 4, duplicates="drop").count() == 10


def test_concurrency_ties(spark):
    runs = [("A", 0, 10), ("A", 0, 5), ("A", 5, 7), ("A", 10, 12), ("A", 3, 3), ("B", 4, 6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "uuid int, system string, startTime long, endTime long")
    got = {r.uuid: r.in_flight for r in results.concurrency(df).collect()}
    assert got == {i: sum(1 for s, a, b in runs if s == sys and a <= start < b) for i, (sys, start, _) in enumerate(runs)}


def random_points(n=400, seed=6):
    rng = random.Random(seed)
    pts = [(rng.gauss(cx, 0.3), rng.gauss(cy, 0.3)) for cx, cy in ((0, 0), (3, 1), (1, 4)) for _ in range(n // 4)]
    pts += [(rng.uniform(-6, 9), rng.uniform(-6, 9)) for _ in range(n // 8)] + [(2.0, 2.0)] * (n // 8)
    return pts


@pytest.fixture(scope="module")
def cloud(spark):
    pts = random_points()
    return pts, spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "fid long, lon double, lat double")


@pytest.mark.parametrize("limit", [2, 64])
def test_nearest_neighbours(cloud, limit):
    pts, df = cloud
    got = {r.fid: (r.nn, r.d2) for r in process.nearest_neighbours(df, cell_limit=limit).collect()}
    assert len(got) == len(pts)
    for i, (x, y) in enumerate(pts):
        d2, nn = min(((x - a) * (x - a) + (y - b) * (y - b), j) for j, (a, b) in enumerate(pts) if j != i)
        assert got[i] == (nn, d2)


@pytest.mark.parametrize("limit", [1, 4_000_000])
def test_proximity(spark, cloud, limit):
    pts, df = cloud
    other = random_points(80, 11)
    b = spark.createDataFrame(other, "lon double, lat double")
    metres = 30_000.0
    moved = [geo.merc_xy(*p) for p in other]
    want = set()
    for i, p in enumerate(pts):
        x, y = geo.merc_xy(*p)
        if any((x - a) ** 2 + (y - c) ** 2 <= metres**2 for a, c in moved):
            want.add(i)
    rows = [r.fid for r in process.within_distance_of_any(df, b, metres, limit).collect()]
    assert set(rows) == want and len(rows) == len(want) and 0 < len(want) < len(pts)


@pytest.mark.parametrize("eps,least", [(0.2, 4), (0.5, 12), (0.05, 3)])
def test_density_clusters(cloud, eps, least):
    pts, df = cloud
    n = len(pts)
    near = [[j for j in range(n) if (pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2 <= eps * eps] for i in range(n)]
    core = [len(near[i]) >= least for i in range(n)]
    group = {}
    for i in range(n):
        if core[i] and i not in group:
            todo, group[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and j not in group:
                        group[j] = i
                        todo.append(j)
    rows = {r.fid: r for r in clusters.density_clusters(df, eps, least).collect()}
    names = {}
    for i in range(n):
        assert rows[i].core == core[i]
        if core[i]:
            assert names.setdefault(group[i], rows[i].cluster) == rows[i].cluster
        else:
            reached = {group[j] for j in near[i] if core[j]}
            assert (rows[i].cluster is None) == (not reached)
    assert len(set(names.values())) == len(names)
    for i in range(n):
        if not core[i] and rows[i].cluster is not None:
            assert rows[i].cluster in {names[group[j]] for j in near[i] if core[j]}


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(60) if i != 30] + [(100, 101)]
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in [*range(61), 100, 101, 200]], "node string")
    df = spark.createDataFrame([(f"{a:03d}", f"{b:03d}") for a, b in links], "a string, b string")
    groups = {}
    for r in clusters.components(nodes, df).collect():
        groups.setdefault(r.label, set()).add(int(r.node))
    assert sorted(map(sorted, groups.values())) == sorted([list(range(31)), list(range(31, 61)), [100, 101], [200]])


def test_hulls_hold_all_points(spark, cloud):
    pts, df = cloud
    named = df.withColumn("g", (F.col("fid") % 2).cast("string"))
    for g in (0, 1):
        corners = [(r.x, r.y) for r in clusters.convex_hulls(named, "g").filter(F.col("g") == str(g)).orderBy("seq").collect()]
        own = [p for i, p in enumerate(pts) if i % 2 == g]
        assert set(corners) <= set(own) and 3 <= len(corners) < len(own)
        for a, b in zip(corners, corners[1:] + corners[:1]):
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-12 for x, y in own)


def test_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "id long, t string, lon double, lat double"
    # the watermark of a batch drops late rows from the batch after next on
    batches = [[(1, "2024-01-01 00:10:00"), (2, "2024-01-01 02:00:00")], [(4, "2024-01-01 03:30:00")], [(3, "2024-01-01 00:20:00"), (5, "2024-01-01 09:00:00")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(a, t, 10.0, 10.0) for a, t in rows], schema).withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
        df.coalesce(1).write.mode("append").parquet(f"{source}/{i}")
        schema_out = df.schema
    import os
    import time
    for i in range(len(batches)):  # files are read in order of their time
        for name in os.listdir(f"{source}/{i}"):
            os.utime(f"{source}/{i}/{name}", (time.time() - 100 + i * 10,) * 2)
    stream = jobs.read_stream(spark, f"{source}/*", schema_out, files_per_batch=1)
    out = jobs.drain(jobs.cell_counts(stream, 4, "1 hour", "10 minutes"), "late")
    counts = {str(r.start): r.n for r in out.collect()}
    assert counts == {"2024-01-01 00:00:00": 1, "2024-01-01 02:00:00": 1, "2024-01-01 03:00:00": 1}


def test_latest_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, rows in enumerate([[("a", 1, 1.0), ("b", 5, 2.0)], [("a", 3, 3.0), ("b", 4, 9.0)]]):
        df = spark.createDataFrame(rows, "k string, t long, v double")
        df.coalesce(1).write.parquet(f"{source}/{i}")
    stream = jobs.read_stream(spark, f"{source}/*", df.schema, files_per_batch=1)
    got = sorted((r.k, r.t, r.v) for r in jobs.latest(stream, "k", "t", ["t", "v"]).collect())
    assert got == [("a", 3, 3.0), ("b", 5, 2.0)]


def settled_brute(points, k):
    """Lloyd's rounds until no point changes its cluster."""
    order = sorted(points, key=lambda r: (hashlib.md5(f"kmeans|{r[0]}".encode()).hexdigest(), r[0]))
    centres, before = [r[1:] for r in order[:k]], None
    while True:
        own = [min(((x - c[0]) ** 2 + (y - c[1]) ** 2, n) for n, c in enumerate(centres)) for _, x, y in points]
        if (now := [n for _, n in own]) == before:
            return centres, sum(d for d, _ in own) / len(own) / 2
        before = now
        for n in range(k):
            if mine := [p for p, m in zip(points, now, strict=True) if m == n]:
                centres[n] = (sum(p[1] for p in mine) / len(mine), sum(p[2] for p in mine) / len(mine))


def test_clusters_settle(spark):
    draw = random.Random(3)
    points = [(i, draw.gauss(10 * (i % 3), 1.5), draw.gauss(8 * (i % 2), 1.5)) for i in range(300)]
    df = spark.createDataFrame(points, "fid long, lon double, lat double").cache()
    best, rows = clusters.jump_method(df, ["lon", "lat"], 6, rounds=None)
    want = [settled_brute(points, k)[1] for k in range(1, 7)]
    assert [d for _, d, _ in rows] == pytest.approx(want, rel=1e-9)
    assert best == max(range(6), key=lambda n: 1 / want[n] - (1 / want[n - 1] if n else 0)) + 1
    clustered, centres = clusters.settled_kmeans(df, ["lon", "lat"], 12)
    assert [v for c in centres for v in c] == pytest.approx([v for c in settled_brute(points, 12)[0] for v in c], rel=1e-9)
    assert clustered.count() == 300 and clusters.settled_kmeans(df.limit(0), ["lon", "lat"], 12)[1] == []
    # two rounds, as the query with SQL has, are not settled clusters
    assert clusters.jump_method(df, ["lon", "lat"], 6, rounds=2)[1][5][1] != pytest.approx(want[5], rel=1e-6)


def test_density_clusters_write_few_rows(spark, monkeypatch):
    """Crowded cells next to each other: no row for each pair of finer cells."""
    draw = random.Random(11)
    cloud = [(i, draw.randint(0, 1200) / 1000.0, draw.randint(0, 1200) / 1000.0) for i in range(6000)]
    written, cut = [], clusters.cut_lineage
    monkeypatch.setattr(clusters, "cut_lineage", lambda df: (lambda out: written.append(out.count()) or out)(cut(df)))
    rows = clusters.density_clusters(spark.createDataFrame(cloud, "fid long, lon double, lat double"), 0.2, 4).collect()
    assert {(r.cluster, r.core) for r in rows} == {(0, True)} and len(rows) == len(cloud)
    assert sum(written) < 10 * len(cloud)


def test_tube_pairs_come_once(spark):
    """Ids that repeat at one place, and at another place and time, meet a track in one row."""
    from datetime import datetime, timedelta
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    features = [(1, at(30), 0.5, 0.0), (1, at(30), 0.5, 0.0), (2, at(10), 0.1666, 0.0), (2, at(200), 3.33, 0.0), (3, at(60), 1.0, 0.0), (4, at(60), 1.0, 3.0), (None, at(5), 0.08, 0.0)]
    segments = [("t", at(0), at(60), 0.0, 0.0, 1.0, 0.0), ("t", at(60), at(300), 1.0, 0.0, 5.0, 0.0)]
    found = process.tube_select(spark.createDataFrame(features, "fid long, ts timestamp_ntz, lon double, lat double"),
                                spark.createDataFrame(segments, "track string, t1 timestamp_ntz, t2 timestamp_ntz, x1 double, y1 double, x2 double, y2 double"), 20_000.0, 50.0)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "t"), (2, "t"), (3, "t"), (None, "t")]


def test_tube_pairs_are_not_shuffled(spark):
    """The only exchanges are those of the join: pairs are made distinct where they arise."""
    import re
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        segments = spark.range(50).selectExpr("concat('t', id % 7) AS track", "timestamp_ntz'2024-01-01 00:00:00' AS t1", "timestamp_ntz'2024-01-01 02:00:00' AS t2",
                                              "id / 50D AS x1", "0D AS y1", "id / 40D AS x2", "0.2D AS y2")
        features = spark.range(50).selectExpr("id AS fid", "timestamp_ntz'2024-01-01 01:00:00' AS ts", "id / 50D AS lon", "0.1D AS lat")
        plan = process.tube_select(features, segments, 20_000.0, 50.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_settled_centres_take_rows_without_a_place(spark):
    """The nearest centre as plain arithmetic: ties to the smaller number, a row without a place in cluster 0."""
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, None, 1.0)], "fid long, lon double, lat double")
    rows = clusters._nearest_of(df, ["lon", "lat"], [(0.0, 0.0), (2.0, 0.0)]).orderBy("fid").collect()
    assert [(r.cluster, r.distance) for r in rows] == [(0, 0.0), (0, 1.0), (1, 0.0), (0, None)]
