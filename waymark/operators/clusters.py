"""Clusters of points: k-means, number of clusters, hulls, density clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.operators.skew import attach, join_measured, salted_join
from waymark.session import cut_lineage

ROUNDS = 10_000  # far more than k-means needs to settle


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fit_kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 1, rounds: int = 20) -> tuple[DataFrame, KMeansModel]:
    """Features with their ``cluster`` and the model."""
    vectors = _vectors(df, columns)
    model = KMeans(k=k, seed=seed, maxIter=rounds, predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("features"), model


def _nearest(columns: Sequence[str]) -> Column:
    """(squared distance, number) of the nearest of an array of centres; ties to the smaller number."""
    gap = lambda c, x: F.col(x) - c[x]
    return F.array_min(F.transform("_centres", lambda c: F.struct(
        reduce(lambda a, b: a + b, [gap(c, x) * gap(c, x) for x in columns]).alias("d"), c["cluster"].alias("cluster"))))


def _nearest_of(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """Rows with the ``cluster`` and squared ``distance`` of the nearest of some centres, written out as plain arithmetic; ties to
    the smaller number. A row without a place is in cluster 0 and has no distance, as in :func:`_nearest`."""
    gaps = {f"_d{n}": reduce(lambda a, b: a + b, [(F.col(x) - F.lit(v)) * (F.col(x) - F.lit(v)) for x, v in zip(columns, c, strict=True)]) for n, c in enumerate(centres)}
    known = reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in gaps])
    near = df.withColumns(gaps).withColumn("distance", F.when(known, F.least(*gaps, F.lit(float("nan")))))  # NaN is the largest
    number = reduce(lambda rest, n: F.when(F.col(f"_d{n}") == F.col("distance"), n).otherwise(rest), reversed(range(len(centres))), F.lit(0))
    return near.withColumn("cluster", number).select(*df.columns, "cluster", "distance")


def group_kmeans(
    df: DataFrame, columns: Sequence[str], k: int, by: Sequence[str] = (), rounds: int = 10, fid: str = "fid", seed: str = "kmeans",
) -> tuple[DataFrame, DataFrame]:
    """k-means of every group by itself: rows with ``cluster`` and squared ``distance``, and the centres.

    Each group starts from its k rows of the smallest hash. A round assigns every row to its group's nearest centre and
    moves the centres to the means; a centre without rows stays. Rows are never gathered by group: the small table of
    centres comes to them. Groups of fewer than k rows have fewer clusters; null groups are groups.
    """
    by = list(by)
    draw = F.md5(F.concat(F.lit(seed + "|"), F.col(fid).cast("string")))
    order = Window.partitionBy(*by).orderBy(draw, fid) if by else None
    if by:
        first = df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).withColumn("cluster", F.col("_r") - 1)
    else:
        first = df.orderBy(draw, fid).limit(k).withColumn("cluster", F.row_number().over(Window.orderBy(draw, fid)) - 1)  # k rows
    centres = cut_lineage(first.select(*by, "cluster", *[F.col(c).cast("double") for c in columns]))
    for done in range(rounds + 1):
        lists = cut_lineage(centres.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cluster", *columns))).alias("_centres")))  # k per group
        best = attach(df, lists, by) if by else df.crossJoin(F.broadcast(lists))  # the latter is one row
        best = best.withColumn("_best", _nearest(columns)).withColumn("cluster", F.col("_best.cluster")).withColumn("distance", F.col("_best.d")).drop("_best", "_centres")
        if done == rounds:
            return best, centres
        means = cut_lineage(best.groupBy(*by, "cluster").agg(*[F.avg(c).alias(f"_{c}") for c in columns]))
        centres = cut_lineage(attach(centres, means, [*by, "cluster"]).select(*by, "cluster", *[F.coalesce(f"_{c}", c).alias(c) for c in columns]))


def settled_kmeans(df: DataFrame, columns: list[str], k: int, fid: str = "fid", seed: str = "kmeans") -> tuple[DataFrame, list[tuple[float, ...]]]:
    """k-means of all rows, started as in ``group_kmeans``, in rounds until the centres stay: rows with ``cluster`` and
    squared ``distance``, and the centres.

    A centre stays if it moves by less than 1e-12 of the largest coordinate, which is the noise of adding rows in another
    order. Only the k centres come to the driver. Rounds that do not settle within ``ROUNDS`` raise.
    """
    first = df.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(fid).cast("string"))), fid).limit(k)
    centres = [tuple(float(v) for v in r) for r in first.select(*columns).collect()]  # k rows
    if not centres:
        return df.withColumn("cluster", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("double")), []
    for _ in range(ROUNDS):
        best = _nearest_of(df, columns, centres)
        means = {r[0]: tuple(r[1:]) for r in best.groupBy("cluster").agg(*[F.avg(c) for c in columns]).collect()}  # at most k rows
        after = [tuple(m if m is not None else o for m, o in zip(means.get(n, c), c, strict=True)) for n, c in enumerate(centres)]
        if all(abs(x - y) <= 1e-12 * max(abs(v) for o in centres for v in o) for o, m in zip(centres, after, strict=True) for x, y in zip(o, m, strict=True)):
            return best, centres
        centres = after
    raise RuntimeError(f"{k} centres still move after {ROUNDS} rounds")


def jump_method(
    df: DataFrame, columns: list[str], k_max: int, rounds: int | None = 10, fid: str = "fid", seed: str = "kmeans",
) -> tuple[int, list[tuple[int, float, float]]]:
    """Number of clusters with the largest jump of the transformed distortion d_k^(-p/2).

    The distortion is the mean squared distance to the own centre per dimension (identity covariance), after so many
    rounds, or if None after the centres have settled.
    """
    p = len(columns)
    rows, before = [], 0.0
    for k in range(1, k_max + 1):
        best = settled_kmeans(df, columns, k, fid, seed)[0] if rounds is None else group_kmeans(df, columns, k, (), rounds, fid, seed)[0]
        distortion = (best.agg(F.avg("distance")).first()[0] or 0.0) / p
        transformed = distortion ** (-p / 2) if distortion > 0 else float("inf")
        rows.append((k, distortion, transformed - before))
        before = transformed
    return max(rows, key=lambda r: r[2])[0], rows


def _chain(points: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull, counter-clockwise."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    lower, upper = half(points), half(points[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _hull_frame(key: str, value, points: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({key: None if pd.isna(value) else value, "x": points[:, 0], "y": points[:, 1]})


def convex_hulls(df: DataFrame, group: str, x: str = "lon", y: str = "lat", parts: int = 16) -> DataFrame:
    """``group, seq, x, y``: hull corners of each group.

    Every batch of a task reduces to the corners of its own groups before anything is shuffled; the corners
    meet in ``parts`` pieces per group and at last once per group. A hull has few corners compared with
    its points (on an n x n coordinate grid at most in the order of n^(2/3)).
    """
    kind = dict(df.dtypes)[group]
    schema = f"`{group}` string, x double, y double"  # as text a null group stays null and a number exact

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value, rows in batch.groupby(group, sort=False, dropna=False):
                yield _hull_frame(group, value, _chain(rows[["x", "y"]].to_numpy()))

    def per_part(rows: pd.DataFrame) -> pd.DataFrame:
        return _hull_frame(group, rows[group].iloc[0], _chain(rows[["x", "y"]].to_numpy()))

    def numbered(rows: pd.DataFrame) -> pd.DataFrame:
        out = per_part(rows)
        out.insert(1, "seq", np.arange(len(out)))
        return out

    corners = df.select(F.col(group).cast("string"), F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(per_batch, schema)
    part = F.pmod(F.xxhash64("x", "y"), F.lit(parts)).alias("_part")
    fewer = corners.groupBy(group, part).applyInPandas(per_part, schema)
    return fewer.groupBy(group).applyInPandas(numbered, f"`{group}` string, seq bigint, x double, y double").withColumn(
        group, F.col(group).cast(kind))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: one label per connected component of string nodes. Links go both ways.

    Nodes are ordered by a hash, so that the smallest neighbour of a node is a random one. Each round every
    node joins its smallest neighbour, follows three steps up, and the links are redrawn between the groups;
    the number of groups falls by a constant factor per round. Rounds end on written tables.
    """
    name = lambda c: F.concat(F.hex(F.xxhash64(c)), F.lit("/"), F.col(c))
    labels = nodes.select("node", name("node").alias("label"))
    both = links.select(name("a").alias("a"), name("b").alias("b"))
    open_links = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while not open_links.isEmpty():
        up = cut_lineage(open_links.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up")))
        step = up.select(F.col("a").alias("up"), F.col("up").alias("next"))
        twice = up.join(step, "up").select("a", F.col("next").alias("up"))
        up = cut_lineage(twice.join(twice.select(F.col("a").alias("up"), F.col("up").alias("next")), "up").select("a", F.col("next").alias("up")))
        labels = labels.join(up.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        ends = up.withColumnRenamed("a", "b").withColumnRenamed("up", "up_b")
        open_links = cut_lineage(open_links.join(up, "a").join(ends, "b").filter(F.col("up") != F.col("up_b")).select(
            F.col("up").alias("a"), F.col("up_b").alias("b")).distinct())
    return cut_lineage(labels)


_SUB = 8  # finer cells per side, for two crowded neighbours


def density_clusters(df: DataFrame, eps: float, min_points: int, fid: str = "fid", x: str = "lon", y: str = "lat") -> DataFrame:
    """``fid, cluster, core``: DBSCAN in planar units; a cluster is named by the smallest id of its core points, noise is null.

    The cell side is eps / sqrt 2, so points of one cell are neighbours without any comparison: a cell with
    ``min_points`` is all core. Comparisons are left for points of thin cells (each holds fewer than
    ``min_points``) and for pairs of crowded cells, which finer cells settle first. Copies count by weight.
    A border point joins the smallest of the clusters it touches.
    """
    side = eps / 2**0.5
    cell = lambda v, s: F.floor(F.col(v) / F.lit(s))
    points = df.select(F.col(fid).alias("fid"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    places = points.groupBy("x", "y").agg(F.count("*").alias("w"), F.min("fid").alias("low")).withColumn("cx", cell("x", side)).withColumn("cy", cell("y", side))
    places = places.join(places.groupBy("cx", "cy").agg((F.sum("w") >= min_points).alias("crowded")), ["cx", "cy"])
    places = cut_lineage(places)
    near_cells = [(i, j) for i in range(-2, 3) for j in range(-2, 3)
                  if (i, j) != (0, 0) and max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= 2]
    offsets = lambda pairs: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])

    def pairs(thin: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of thin cells with the places within eps in the cells around them and their own."""
        probe = thin.select("*", F.inline(offsets([(0, 0), *near_cells]))).withColumn("kx", F.col("cx") + F.col("i")).withColumn(
            "ky", F.col("cy") + F.col("j")).drop("i", "j")
        other = others.select(F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"))
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        return salted_join(other, probe, ["kx", "ky"], ["ox", "oy"]).filter(dx * dx + dy * dy <= F.lit(eps * eps))

    thin = places.filter(~F.col("crowded")).drop("w", "low")
    thin_core = pairs(thin, places).groupBy("x", "y", "cx", "cy").agg(F.sum("ow").alias("n")).filter(F.col("n") >= min_points)
    core = cut_lineage(places.filter("crowded").select("x", "y", "w", "cx", "cy", "crowded").unionByName(
        thin_core.join(places.select("x", "y", "w"), ["x", "y"]).select("x", "y", "w", "cx", "cy", F.lit(False).alias("crowded"))))

    node = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    core_cells = core.select("cx", "cy").distinct()
    thin_links = pairs(core.filter(~F.col("crowded")).drop("w"), core).select(
        node("cx", "cy").alias("a"), node("kx", "ky").alias("b")).distinct()

    # crowded next to crowded: each cell's farthest place towards a neighbour and the neighbour's farthest towards it link most pairs
    crowded = core.filter("crowded")
    towards = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"t{n}.x").alias("x"), F.col(f"t{n}.y").alias("y")) for n, (i, j) in enumerate(near_cells)]
    ends = cut_lineage(crowded.groupBy("cx", "cy").agg(*[
        F.max(F.struct(F.col("x") * i + F.col("y") * j, "x", "y")).alias(f"t{n}") for n, (i, j) in enumerate(near_cells)]).select("cx", "cy", F.inline(F.array(*towards))))
    there = ends.select(F.col("cx").alias("kx"), F.col("cy").alias("ky"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    here = ends.filter("i > 0 OR i = 0 AND j > 0").withColumn("kx", F.col("cx") + F.col("i")).withColumn("ky", F.col("cy") + F.col("j"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    faced = cut_lineage(here.join(there, ["kx", "ky", "i", "j"]).select("cx", "cy", "kx", "ky", (dx * dx + dy * dy <= F.lit(eps * eps)).alias("met")))
    as_link = [node("cx", "cy").alias("a"), node("kx", "ky").alias("b")]
    labels = components(core_cells.select(node("cx", "cy").alias("node")), thin_links.unionByName(faced.filter("met").select(*as_link)).filter(F.col("a") != F.col("b")))

    # pairs that are in one component need no more; for the others finer cells decide where their corners allow it
    label_of = lambda at, name: labels.select(F.col("node").alias(at), F.col("label").alias(name))
    apart = faced.filter(~F.col("met")).select("cx", "cy", "kx", "ky", *as_link)
    apart = cut_lineage(apart.join(label_of("a", "la"), "a").join(label_of("b", "lb"), "b").filter(F.col("la") != F.col("lb")).drop("a", "b"))
    if not apart.isEmpty():
        fine = side / _SUB
        # corner distances may be off by a rounding error, so "sure" asks for a little less than eps
        i, j = F.abs(F.col("sx") - F.col("tx")), F.abs(F.col("sy") - F.col("ty"))
        beyond = lambda d: F.greatest(d - 1, F.lit(0))
        far = ((i + 1) * (i + 1) + (j + 1) * (j + 1)) * F.lit(fine * fine) <= F.lit(eps * eps * (1 - 1e-9))
        near = (beyond(i) * beyond(i) + beyond(j) * beyond(j)) * F.lit(fine * fine) <= F.lit(eps * eps * (1 + 1e-9))
        sub = crowded.select("cx", "cy", cell("x", fine).alias("sx"), cell("y", fine).alias("sy")).distinct()
        there = sub.select(F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("sx").alias("tx"), F.col("sy").alias("ty"))
        met = apart.join(sub, ["cx", "cy"]).join(there, ["kx", "ky"]).filter(near).withColumn("sure", far)
        sure = cut_lineage(met.filter("sure").select("la", "lb").distinct())
        open_sub = cut_lineage(met.filter(~F.col("sure")).join(sure, ["la", "lb"], "left_anti").select("cx", "cy", "kx", "ky", "sx", "sy", "tx", "ty", "la", "lb"))
        fine_at = [cell("x", fine), cell("y", fine)]
        left = crowded.select("cx", "cy", fine_at[0].alias("sx"), fine_at[1].alias("sy"), "x", "y")
        right = crowded.select(F.col("cx").alias("kx"), F.col("cy").alias("ky"), fine_at[0].alias("tx"), fine_at[1].alias("ty"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        tested = salted_join(left, open_sub, ["cx", "cy", "sx", "sy"], ["x", "y"])
        tested = salted_join(right, tested, ["kx", "ky", "tx", "ty"], ["ox", "oy"]).filter(dx * dx + dy * dy <= F.lit(eps * eps)).select("la", "lb").distinct()
        over = components(labels.select(F.col("label").alias("node")).distinct(), sure.unionByName(tested).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        labels = cut_lineage(labels.withColumnRenamed("label", "under").join(over.withColumnRenamed("node", "under"), "under").select("node", "label"))
    # a cluster is named by the smallest id among its core points
    labelled = cut_lineage(core.withColumn("node", node("cx", "cy")).join(labels, "node").join(places.select("x", "y", "low"), ["x", "y"]))
    names = labelled.groupBy("label").agg(F.min("low").alias("cluster"))
    core_named = labelled.join(names, "label").select("x", "y", "cluster", F.lit(True).alias("core"))
    cell_names = cut_lineage(labelled.select("node", "label").distinct().join(names, "label").select("node", "cluster"))
    edge = thin.join(core.select("x", "y"), ["x", "y"], "left_anti")
    border = pairs(edge, core).select("x", "y", node("kx", "ky").alias("node")).distinct().join(cell_names, "node").groupBy("x", "y").agg(
        F.min("cluster").alias("cluster"), F.lit(False).alias("core"))
    marked = core_named.unionByName(border)
    return join_measured(points, marked, ["x", "y"], ["fid"], "left").select("fid", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
