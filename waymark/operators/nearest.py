"""The k nearest other features of every feature, over a quadtree split by counts.

Features at one place are one place that keeps its ``k + 1`` smallest ids. The world of the places is split into quarters until
no leaf holds more than ``limit`` places: coarse leaves come from one count of fine cells rolled up, and only places in
cells that are still too full go on to the next level. A place looks at its own leaf first; the leaves are compared in Arrow batches. Its
``k``-th best distance, or, if the leaf holds too few, the diagonal of the parent, which holds more than ``limit`` places,
bounds the search; a place whose bound stays within its leaf is done. The other leaves in reach are found once for all such
places of a leaf, through the cells of a level as wide as the box of their bounds; a place looks at those that its own bound reaches.

No pass moves features against all others, a leaf bounds what a task compares at once, and the number of leaves is about
places / ``limit``. Distances are planar, in degrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.operators.skew import BROADCAST_ROWS, join_measured, salted_join
from waymark.session import cut_lineage

MAX_LEVEL = 48  # cells there are as fine as doubles
_CELL = ["lv", "cx", "cy"]


class _Grid:
    """Quarters of quarters of the box of all places."""

    def __init__(self, xmin: float, ymin: float, xmax: float, ymax: float):
        self.low, self.width = (xmin, ymin), (max(xmax - xmin, 1e-9), max(ymax - ymin, 1e-9))

    def cell(self, value: Column, axis: int, level: Column) -> Column:
        n = F.pow(F.lit(2.0), level)
        at = F.floor((value - F.lit(self.low[axis])) / F.lit(self.width[axis]) * n)
        return F.greatest(F.lit(0).cast("long"), F.least(at, (n - 1).cast("long")))

    def cells(self, level: Column) -> list[Column]:
        return [level.cast("int").alias("lv"), self.cell(F.col("x"), 0, level).alias("cx"), self.cell(F.col("y"), 1, level).alias("cy")]


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def with_leaves(places: DataFrame, grid: _Grid, n: int, limit: int) -> DataFrame:
    """``places`` (x, y, ..) with the leaf of each: lv, cx, cy."""
    level = 0
    while 4 ** level * limit < n:
        level += 1
    counts = cut_lineage(places.groupBy(*grid.cells(F.lit(level))).agg(F.count("*").alias("c")))
    above = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(level))).alias("up"))
    scale = F.pow(F.lit(2.0), F.lit(level) - F.col("up"))
    above = above.withColumn("ax", F.floor(F.col("cx") / scale)).withColumn("ay", F.floor(F.col("cy") / scale))
    fine = above.groupBy("up", "ax", "ay").agg(F.sum("c").alias("total")).filter(F.col("total") <= limit)
    top = cut_lineage(above.join(fine, ["up", "ax", "ay"]).groupBy("cx", "cy").agg(F.min("up").alias("leaf")))
    keyed = places.select("*", *grid.cells(F.lit(level)))
    placed = keyed.join(_small(top), ["cx", "cy"], "left")
    columns = [F.col(c) for c in places.columns]
    parts = [placed.filter("leaf IS NOT NULL").select(*columns, *grid.cells(F.col("leaf")))]
    full = placed.filter("leaf IS NULL").select(*columns)
    while not (full := cut_lineage(full)).isEmpty():
        level += 1
        keyed = full.select(*columns, *grid.cells(F.lit(level)))
        crowded = cut_lineage(keyed.groupBy("cx", "cy").agg(F.count("*").alias("c")).filter(F.col("c") > (limit if level < MAX_LEVEL else 1 << 62)).select("cx", "cy"))
        crowded = _small(crowded)
        parts.append(keyed.join(crowded, ["cx", "cy"], "left_anti").select(*columns, *_CELL))
        full = keyed.join(crowded, ["cx", "cy"], "left_semi").select(*columns)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best (d2, id) of every place ``qx, qy``."""
    order = Window.partitionBy("qx", "qy").orderBy("d2", "id")
    return candidates.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def _compared(pairs: DataFrame) -> DataFrame:
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    return pairs.withColumn("d2", dx * dx + dy * dy)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``starts[i]`` on, ``sizes[i]`` of them, with their ``i``."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _position(groups: np.ndarray, n: int) -> np.ndarray:
    """Position of each in its group; the sorted ``groups`` are numbers below ``n``."""
    counts = np.bincount(groups, minlength=n)
    return np.arange(len(groups)) - np.repeat(np.cumsum(counts) - counts, counts)


def _best_of_leaves(rows: pa.Table, k: int) -> pa.Array:
    """The k + 1 best (d2, id) of each place in its own leaf; rows of one leaf stand together."""
    keys = np.stack([rows[c].to_numpy() for c in _CELL])
    n, starts = rows.num_rows, np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
    sizes = np.diff(np.r_[starts, n])
    q, p = _pairs(np.repeat(starts, sizes), np.repeat(sizes, sizes))
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    dx, dy = x[q] - x[p], y[q] - y[p]
    d2 = dx * dx + dy * dy
    order = np.lexsort((d2, q))
    q, p, d2 = q[order], p[order], d2[order]
    last = np.minimum(np.repeat(sizes, sizes) - 1, k) + np.cumsum(np.repeat(sizes, sizes)) - np.repeat(sizes, sizes)
    near = d2 <= d2[last][q]  # the k + 1 nearest places and those as far as the last of them
    q, p, d2 = q[near], p[near], d2[near]
    lists = rows["ids"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds, ids = lists.offsets.to_numpy(), lists.values
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    of, i = _pairs(bounds[:-1][p].astype(np.int64), np.diff(bounds)[p])
    q, d2 = q[of], d2[of]
    order = np.lexsort((rank[i], d2, q))
    q, d2, i = q[order], d2[order], i[order]
    taken = _position(q, n) <= k
    best = pa.StructArray.from_arrays([pa.array(d2[taken]), ids.take(pa.array(i[taken]))], ["d2", "id"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(q[taken], minlength=n))], pa.int32()), best)


def _own_best(tree: DataFrame, k: int) -> DataFrame:
    """``tree`` with ``qx, qy`` for its places and the k + 1 ``best`` (d2, id) of each in its own leaf."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                yield from rows.append_column("best", _best_of_leaves(rows, k)).rename_columns([*_CELL, "qx", "qy", "ids", "crowded", "best"]).combine_chunks().to_batches()

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            keys = np.stack([held[c].to_numpy() for c in _CELL])
            # the last leaf may go on in the next batch
            behind = np.flatnonzero((keys != keys[:, -1:]).any(axis=0)) if held.num_rows else []
            cut = int(behind[-1]) + 1 if len(behind) else 0
            yield from done(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
        if held is not None:
            yield from done(held.combine_chunks())

    ids = tree.schema["ids"].dataType
    schema = f"lv int, cx bigint, cy bigint, qx double, qy double, ids {ids.simpleString()}, crowded boolean, best array<struct<d2:double,id:{ids.elementType.simpleString()}>>"
    rows = tree.select(F.col("lv").cast("int"), F.col("cx").cast("bigint"), F.col("cy").cast("bigint"), "x", "y", "ids", "crowded")
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(search, schema)


def k_nearest(df: DataFrame, k: int, fid: str = "fid", limit: int = 32) -> DataFrame:
    """``fid, rank, nn, d2``: the k nearest other features of each, by squared distance, smaller id on a tie.

    With fewer than k others there are fewer rows; features without a place have none. Ids name features and do not repeat.
    """
    points = df.select(F.col(fid).alias("fid"), F.col("lon").alias("x"), F.col("lat").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    limit = max(limit, k + 1)
    ranked = points.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("fid"))).filter(F.col("_r") <= k + 2)
    places = cut_lineage(ranked.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.when(F.col("_r") <= k + 1, F.col("fid")))).alias("ids"), (F.max("_r") > k + 1).alias("crowded")))
    n, *box = places.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n:
        return points.select("fid", F.lit(1).alias("rank"), F.col("fid").alias("nn"), F.lit(0.0).alias("d2")).limit(0)
    grid = _Grid(*box)
    tree = with_leaves(places, grid, n, limit)

    # a leaf is bounded, so are its pairs of places
    own = _own_best(tree, k)
    enough = F.size("best") > k
    diagonal = F.pow(F.lit(2.0), 1 - F.col("lv"))
    reach = F.when(enough, F.element_at("best", -1)["d2"]).otherwise(
        (F.pow(diagonal * grid.width[0], F.lit(2)) + F.pow(diagonal * grid.width[1], F.lit(2))) * (1 + 1e-9))
    own = cut_lineage(own.withColumn("r2", reach))
    r = F.sqrt("r2") * (1 + 1e-12)
    side = [F.lit(w) / F.pow(F.lit(2.0), F.col("lv")) for w in grid.width]
    inside = [(q - r - F.lit(low) > c * s) & (q + r - F.lit(low) < (c + 1) * s)
              for q, low, c, s in zip((F.col("qx"), F.col("qy")), grid.low, (F.col("cx"), F.col("cy")), side, strict=True)]
    searching = own.filter((F.col("lv") > 0) & ~(inside[0] & inside[1]))

    # leaves in reach of a leaf's searching places together: those below the cells of a level as wide as the box of all their
    # reaches, and coarser ones around these cells; each place then looks at the few leaves that its own leaf has found
    leaves = cut_lineage(tree.groupBy(*_CELL).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum(F.size("ids")).alias("n")))
    boxes = searching.groupBy(*_CELL).agg(F.min(F.col("qx") - r).alias("bx0"), F.max(F.col("qx") + r).alias("bx1"), F.min(F.col("qy") - r).alias("by0"), F.max(F.col("qy") + r).alias("by1"))
    fit = F.least(*[F.lit(w) / F.greatest(F.col(b) - F.col(a), F.lit(w * 2.0 ** -MAX_LEVEL)) for w, a, b in zip(grid.width, ("bx0", "by0"), ("bx1", "by1"), strict=True)])
    level = F.least(F.lit(MAX_LEVEL), F.greatest(F.lit(0), F.floor(F.log2(fit)))).cast("int")
    query = boxes.withColumnsRenamed({"lv": "_lv", "cx": "_cx", "cy": "_cy"}).withColumn("ql", level)
    ends = [grid.cell(F.col(b), axis, F.col("ql")) for axis, names in enumerate((("bx0", "bx1"), ("by0", "by1"))) for b in names]
    around = F.flatten(F.transform(F.sequence(ends[0], ends[1]), lambda a: F.transform(F.sequence(ends[2], ends[3]), lambda b: F.struct(a.alias("cx"), b.alias("cy")))))
    query = cut_lineage(query.withColumn("around", around))
    keys, own_leaf = ["ql", "kx", "ky"], ["_lv", "_cx", "_cy"]
    wide = query.select("*", F.inline("around")).drop("around").withColumnsRenamed({"cx": "kx", "cy": "ky"})
    up = F.pow(F.lit(2.0), F.col("lv") - F.col("ql"))
    below = leaves.withColumn("ql", F.explode(F.sequence(F.lit(0), F.col("lv")))).withColumn("kx", F.floor(F.col("cx") / up)).withColumn("ky", F.floor(F.col("cy") / up))
    coarser = F.flatten(F.transform(F.sequence(F.lit(0), F.col("ql") - 1), lambda a: F.array_distinct(F.transform("around", lambda c: F.struct(
        a.alias("ql2"), F.floor(c["cx"] / F.pow(F.lit(2.0), F.col("ql") - a)).alias("kx"), F.floor(c["cy"] / F.pow(F.lit(2.0), F.col("ql") - a)).alias("ky"))))))
    over = query.filter("ql > 0").select("*", F.inline(coarser)).drop("around", "ql").withColumnRenamed("ql2", "ql")
    themselves = leaves.withColumns({"ql": F.col("lv"), "kx": F.col("cx"), "ky": F.col("cy")})
    columns = [*own_leaf, "bx0", "bx1", "by0", "by1", *_CELL, "n", "x0", "x1", "y0", "y1"]
    met = salted_join(wide, below, keys, own_leaf).select(*columns).unionByName(salted_join(over, themselves, keys, own_leaf).select(*columns))
    other = (F.col("lv") != F.col("_lv")) | (F.col("cx") != F.col("_cx")) | (F.col("cy") != F.col("_cy"))
    touch = (F.col("x1") >= F.col("bx0")) & (F.col("x0") <= F.col("bx1")) & (F.col("y1") >= F.col("by0")) & (F.col("y0") <= F.col("by1"))
    met = cut_lineage(met.filter(other & touch).drop("bx0", "bx1", "by0", "by1"))
    asking = searching.select(*[F.col(c).alias(f"_{c}") for c in _CELL], "qx", "qy", "r2")
    gap = [F.greatest(F.col(a) - F.col(q), F.lit(0.0), F.col(q) - F.col(b)) for q, a, b in (("qx", "x0", "x1"), ("qy", "y0", "y1"))]
    far = [F.greatest(F.abs(F.col(q) - F.col(a)), F.abs(F.col(b) - F.col(q))) for q, a, b in (("qx", "x0", "x1"), ("qy", "y0", "y1"))]
    found = salted_join(met, asking, own_leaf, _CELL).select(
        "qx", "qy", "r2", *_CELL, (gap[0] * gap[0] + gap[1] * gap[1]).alias("gap2"), F.when(F.col("n") > k, far[0] * far[0] + far[1] * far[1]).alias("far2"))
    found = cut_lineage(found.filter(F.col("gap2") <= F.col("r2")))
    # a whole leaf of enough features within some distance bounds the search, too
    bounds = found.groupBy("qx", "qy").agg(F.min("far2").alias("bound"))
    left = found.join(bounds, ["qx", "qy"]).withColumn("r2", F.least("r2", "bound")).filter(F.col("gap2") <= F.col("r2")).select("qx", "qy", "r2", *_CELL)
    more = _compared(salted_join(left, tree, _CELL, ["qx", "qy"])).filter(F.col("d2") <= F.col("r2")).select("qx", "qy", F.explode("ids").alias("id"), "d2")
    more = _best(more, k + 1).groupBy("qx", "qy").agg(F.collect_list(F.struct("d2", "id")).alias("_more"))
    merged = F.slice(F.sort_array(F.concat("best", "_more")), 1, k + 1)
    lists = own.join(more, ["qx", "qy"], "left").select(F.col("qx").alias("x"), F.col("qy").alias("y"), "ids", "crowded", F.when(F.col("_more").isNull(), F.col("best")).otherwise(merged).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("fid")), 1, k)
    answers = lists.filter("NOT crowded").select(F.explode("ids").alias("fid"), "best").select("fid", others.alias("others"))
    # a place with more features than its list: all have their neighbours there
    crowded = cut_lineage(own.filter("crowded").select(F.col("qx").alias("x"), F.col("qy").alias("y"), "best"))
    if not crowded.isEmpty():
        answers = answers.unionByName(salted_join(points, crowded, ["x", "y"], ["fid"]).select("fid", others.alias("others")))
    return answers.select("fid", F.posexplode("others").alias("rank", "b")).select("fid", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("nn"), F.col("b.d2").alias("d2"))
