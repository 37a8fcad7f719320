"""Features against a table of query windows.

A window is a shape (box, polygon or map buffer) and a time span with a name. One job answers all
windows together:

1. the shapes are cut into grid cells. A cell wholly inside a polygon needs no further test, a boundary
   cell keeps only the edges a ray from inside the cell can meet;
2. a feature finds its shapes with an equi-join on the cell number, then takes the exact test;
3. the matched (feature, shape) pairs find their time windows with an equi-join on shape and time bucket.

Window tables of a checked size are broadcast, so the features are never shuffled. Larger ones are joined
by a shuffle on the cell with hot cells split (:mod:`waymark.operators.skew`). Counts alone of box windows held as data come
without a row per match (:mod:`waymark.operators.ranges`).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.functions import cells, geo
from waymark.functions.times import ALL_TIME, TimeSpan, in_span, in_span_columns, ntz
from waymark.operators.ranges import extents_per_box, points_per_box, points_per_cover
from waymark.operators.skew import salted_join

Box = tuple[float, float, float, float]

# rows after they have grown: one per shape and cell, one per window and time bucket
BROADCAST_MAX_CHIPS = 800_000
BROADCAST_MAX_EDGES = 100_000  # a boundary cell repeats the edges to its right, about eight times over
BROADCAST_MAX_WINDOW_ROWS = 500_000
BUCKETS_PER_WINDOW = 32

GEOM_SCHEMA = (
    f"geom_id string, xmin double, ymin double, xmax double, ymax double, edges {geo.EDGE_TYPE}, "
    "mx double, my double, metres double, level int"
)
WINDOW_SCHEMA = "name string, geom_id string, lo timestamp_ntz, hi timestamp_ntz, closed boolean"
EVERYWHERE = "everywhere"


@dataclass(frozen=True)
class Shape:
    geom_id: str
    box: Box
    edges: tuple = ()
    circle: tuple[float, float, float] | None = None  # projected centre and metres

    @property
    def level(self) -> int:
        # a polygon gains from small cells (fewer edges each, more cells wholly inside); a box or circle does not
        return cells.level_for(self.box[2] - self.box[0], self.box[3] - self.box[1], 8 if self.edges else 4)

    @property
    def most_cells(self) -> float:
        """A bound on the cells of its cover."""
        xmin, ymin, xmax, ymax = self.box
        return ((xmax - xmin) * 2 ** self.level / 360 + 2) * ((ymax - ymin) * 2 ** self.level / 180 + 2)


def box_shape(geom_id: str, box: Sequence[float]) -> Shape:
    return Shape(geom_id, tuple(float(v) for v in box))


def polygon_shape(geom_id: str, *rings: Sequence[tuple[float, float]]) -> Shape:
    """Polygon or multipolygon: all rings, holes included, under the even-odd rule."""
    xs = [float(p[0]) for r in rings for p in r]
    ys = [float(p[1]) for r in rings for p in r]
    return Shape(geom_id, (min(xs), min(ys), max(xs), max(ys)), tuple(geo.edges_of_rings(rings)))


def envelope_shape(geom_id: str, shape: Shape) -> Shape:
    return Shape(geom_id, shape.box)


def buffer_shape(geom_id: str, lon: float, lat: float, metres: float, mode: str = "distance") -> Shape:
    """Map buffer by distance, or as a 32-sided ring."""
    mx, my = geo.merc_xy(lon, lat)
    if mode == "ring":
        return polygon_shape(geom_id, geo.circle_ring(mx, my, metres))
    # a little wider than the circle: the distance decides
    slack = metres * (1 + 1e-9) + 1e-3
    xmin, ymin = geo.lonlat_of(mx - slack, my - slack)
    xmax, ymax = geo.lonlat_of(mx + slack, my + slack)
    return Shape(geom_id, (xmin, ymin, xmax, ymax), circle=(mx, my, float(metres)))


@dataclass(frozen=True)
class WindowRow:
    name: str
    geom_id: str = EVERYWHERE
    span: TimeSpan = ALL_TIME


@dataclass
class WindowSet:
    """Shapes and windows as DataFrames, with what was checked about their size and reach."""

    geoms: DataFrame
    windows: DataFrame
    levels: list[int]
    n_windows: int
    small: bool
    envelope: Box | None
    span: TimeSpan
    max_seconds: float
    open_ended: bool
    untimed: bool
    has_polygons: bool
    one_span: TimeSpan | None = None  # of a set held as data in which all shapes are boxes and all windows ask for the same time
    shapes: list[Shape] = field(default_factory=list)
    rows: list[WindowRow] = field(default_factory=list)

    @property
    def spatial(self) -> bool:
        return bool(self.levels)


def window_set(spark: SparkSession, shapes: Iterable[Shape], rows: Iterable[WindowRow]) -> WindowSet:
    """Window set from parameters of the calling program (a preset)."""
    shapes, rows = list({s.geom_id: s for s in shapes}.values()), list(rows)
    geoms = spark.createDataFrame(
        [(s.geom_id, *s.box, list(s.edges) or None, *(s.circle or (None,) * 3), s.level) for s in shapes], GEOM_SCHEMA)
    spans = [r.span for r in rows]
    longest = max([(t.hi - t.lo).total_seconds() for t in spans if t.lo and t.hi] or [0.0])
    windows = spark.createDataFrame([(r.name, r.geom_id, *r.span) for r in rows], WINDOW_SCHEMA)
    return WindowSet(
        geoms=geoms, windows=windows,
        levels=sorted({s.level for s in shapes}),
        n_windows=len(rows),
        small=_small(sum(s.most_cells for s in shapes), sum(len(s.edges) for s in shapes), sum(
            (t.hi - t.lo).total_seconds() // _bucket_seconds(longest) + 2 if t.lo and t.hi else 1 for t in spans)),
        envelope=_envelope(shapes), span=_reach(rows), max_seconds=longest,
        open_ended=any(t.lo is None or t.hi is None for t in spans), untimed=all(t.lo is None and t.hi is None for t in spans),
        has_polygons=any(s.edges for s in shapes),
        shapes=shapes, rows=rows,
    )


def _bucket_seconds(longest: float) -> float:
    return max(86400.0, longest / BUCKETS_PER_WINDOW)


def _small(chips: float, edges: float, window_rows: float) -> bool:
    return chips <= BROADCAST_MAX_CHIPS and edges <= BROADCAST_MAX_EDGES and window_rows <= BROADCAST_MAX_WINDOW_ROWS


def _envelope(shapes: list[Shape]) -> Box | None:
    if not shapes:
        return None
    return (min(s.box[0] for s in shapes), min(s.box[1] for s in shapes),
            max(s.box[2] for s in shapes), max(s.box[3] for s in shapes))


def _reach(rows: list[WindowRow]) -> TimeSpan:
    lows, highs = [r.span.lo for r in rows], [r.span.hi for r in rows]
    return TimeSpan(None if None in lows or not rows else min(lows), None if None in highs or not rows else max(highs), True)


def window_set_from_tables(geoms: DataFrame, windows: DataFrame) -> WindowSet:
    """Window set held as data: boxes or edges per ``geom_id`` and windows that name one of them.

    ``geoms`` has geom_id, xmin, ymin, xmax, ymax and may have edges, mx, my, metres. Its size is
    measured here; only a set within the limits is broadcast later.
    """
    missing = {"edges": geo.EDGE_TYPE, "mx": "double", "my": "double", "metres": "double"}
    for name, kind in missing.items():
        if name not in geoms.columns:
            geoms = geoms.withColumn(name, F.lit(None).cast(kind))
    width, height = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    geoms = geoms.withColumn("level", F.when(F.col("edges").isNull(), cells.level_expr(width, height, 4)).otherwise(
        cells.level_expr(width, height, 8)))
    windows = windows.withColumn("closed", F.coalesce("closed", F.lit(False)))
    g = geoms.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.coalesce("edges", F.array().cast(geo.EDGE_TYPE)))), F.lit(0)).alias("edges"),
        F.collect_set("level").alias("levels"), F.count_if(F.col("edges").isNotNull()).alias("polygons"), F.sum(cells.n_box_cells(
            F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("level"))).alias("chips"), F.min("xmin").alias("a"), F.min("ymin").alias("b"),
        F.max("xmax").alias("c"), F.max("ymax").alias("d"), F.count("metres").alias("buffers")).first()
    seconds = cells.unix_seconds(F.col("hi")) - cells.unix_seconds(F.col("lo"))
    w = windows.agg(
        F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(seconds).alias("longest"),
        F.count_if(F.col("lo").isNull()).alias("no_lo"), F.count_if(F.col("hi").isNull()).alias("no_hi"),
        F.count_if(F.coalesce("lo", "hi").isNull()).alias("no_end"), F.sum(seconds).alias("seconds"), F.max("lo").alias("last_lo"), F.min("hi").alias("first_hi"),
        F.min("closed").alias("closed"), F.max("closed").alias("any_closed")).first()
    alike = w["n"] and w["no_lo"] in (0, w["n"]) and w["no_hi"] in (0, w["n"]) and (w["lo"], w["hi"], w["closed"]) == (w["last_lo"], w["first_hi"], w["any_closed"])
    longest = float(w["longest"] or 0)
    return WindowSet(
        geoms=geoms.select(*[f.split()[0] for f in GEOM_SCHEMA.replace(geo.EDGE_TYPE, "x").split(", ")]),
        windows=windows.select("name", "geom_id", "lo", "hi", "closed"),
        levels=sorted(g["levels"]), n_windows=w["n"],
        small=_small(g["chips"] or 0, g["edges"], float(w["seconds"] or 0) / _bucket_seconds(longest) + 2 * w["n"]),
        envelope=(g["a"], g["b"], g["c"], g["d"]) if g["n"] else None,
        span=TimeSpan(None if w["no_lo"] else w["lo"], None if w["no_hi"] else w["hi"], True),
        max_seconds=longest, open_ended=bool(w["no_lo"] or w["no_hi"]), untimed=w["no_end"] == w["n"], has_polygons=g["polygons"] > 0,
        one_span=TimeSpan(w["lo"], w["hi"], w["closed"]) if alike and g["n"] and not g["polygons"] and not g["buffers"] else None,
    )


def shape_chips(geoms: DataFrame, level: Column | None = None, tag: Column | None = None) -> DataFrame:
    """One row per shape and grid cell: ``key`` and the edges that still matter in the cell.

    ``near`` is null when no polygon test is needed (plain box or cell wholly inside); ``polygon`` tells the two apart.
    """
    level = F.col("level") if level is None else level
    tagged = geoms.withColumn("_level", level).withColumn("_tag", level if tag is None else tag)
    cut = tagged.withColumn("_cell", F.explode(cells.box_cells(
        F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("_level"))))
    n = F.pow(F.lit(2.0), F.col("_level"))
    slack = F.lit(1e-9)  # degrees, wider than any rounding of the cell bounds
    x0 = F.col("_cell.cx") / n * 360.0 - 180.0 - slack
    y0 = F.col("_cell.cy") / n * 180.0 - 90.0 - slack
    x1 = (F.col("_cell.cx") + 1) / n * 360.0 - 180.0 + slack
    y1 = (F.col("_cell.cy") + 1) / n * 180.0 - 90.0 + slack
    cut = (
        cut.withColumn("_x0", x0).withColumn("_y0", y0).withColumn("_x1", x1).withColumn("_y1", y1)
        .withColumn("near", F.filter("edges", lambda e: (
            (F.greatest(e["x1"], e["x2"]) >= F.col("_x0")) & (e["y2"] >= F.col("_y0")) & (e["y1"] <= F.col("_y1")))))
        .withColumn("_boundary", F.exists("near", lambda e: F.least(e["x1"], e["x2"]) <= F.col("_x1")))
    )
    inside = geo.in_edges((F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2, F.col("near"))
    return (
        cut.filter(F.col("edges").isNull() | F.col("_boundary") | inside)
        .select(
            cells.cell_key(F.col("_tag") * 32 + F.col("_level"), F.col("_cell.cx"), F.col("_cell.cy")).alias("key"),
            "geom_id", "xmin", "ymin", "xmax", "ymax",
            F.when(F.col("_boundary"), F.col("near")).alias("near"), F.col("edges").isNotNull().alias("polygon"), "mx", "my", "metres")
    )


def _point_keys(lon: Column, lat: Column, levels: Sequence[int]) -> Column:
    keys = [cells.cell_key(lv * 32 + lv, cells.cell_x(lon, lv), cells.cell_y(lat, lv)) for lv in levels]
    return keys[0] if len(keys) == 1 else F.explode(F.array(*keys))


def shape_test(shape: Shape, lon: Column, lat: Column, mode: str = "exact") -> Column:
    """One shape as a filter: box comparisons first (they reach the scan), then the exact part.

    The loose cover of a polygon leaves out cells that it does not touch, so it needs the chips.
    """
    if mode == "loose" and shape.edges:
        raise ValueError("a polygon has no loose test of its own")
    if mode == "loose":
        lv = shape.level
        lo = [F.lit(v) for v in shape.box]
        return (
            cells.cell_x(lon, lv).between(cells.cell_x(lo[0], lv), cells.cell_x(lo[2], lv))
            & cells.cell_y(lat, lv).between(cells.cell_y(lo[1], lv), cells.cell_y(lo[3], lv))
        )
    test = geo.in_box(lon, lat, shape.box)
    if shape.edges:
        test = test & geo.in_edges(lon, lat, geo.edges_literal(shape.edges))
    if shape.circle:
        test = test & geo.within_metres(lon, lat, *[F.lit(v) for v in shape.circle])
    return test


def _match_shapes(features: DataFrame, ws: WindowSet, lon: str, lat: str, mode: str, fid: str) -> DataFrame:
    x, y = F.col(lon), F.col(lat)
    if len(ws.shapes) == 1 and mode != "flag" and not (mode == "loose" and ws.has_polygons):
        return features.filter(shape_test(ws.shapes[0], x, y, mode)).withColumn("geom_id", F.lit(ws.shapes[0].geom_id))
    if mode == "exact" and ws.envelope:
        features = features.filter(geo.in_box(x, y, ws.envelope))
    chips = shape_chips(ws.geoms)
    keyed = features.withColumn("key", _point_keys(x, y, ws.levels))
    if ws.small:
        joined = keyed.join(F.broadcast(chips), "key")
    else:
        joined = salted_join(keyed, chips, ["key"], [fid])
    exact = (
        geo.in_box(x, y, [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])
        & (F.col("near").isNull() | geo.in_edges(x, y, F.col("near")))
        & (F.col("metres").isNull() | geo.within_metres(x, y, F.col("mx"), F.col("my"), F.col("metres")))
    )
    if mode == "exact":
        joined = joined.filter(exact)
    elif mode == "flag":
        joined = joined.withColumn("exact", exact)
    return joined.drop("key", "near", "polygon", "xmin", "ymin", "xmax", "ymax", "mx", "my", "metres")


OPEN_BUCKET = -(2**40)


def match_times(matched: DataFrame, ws: WindowSet, time_col: str, fid: str = "fid") -> DataFrame:
    """(feature, shape) rows to (feature, window) rows. A window without ends takes features without a time, too."""
    ts = F.col(time_col)
    if ws.rows and len(ws.rows) == 1:
        kept = matched if ws.untimed else matched.filter(in_span(ts, ws.rows[0].span))
        return kept.withColumn("name", F.lit(ws.rows[0].name)).drop("geom_id")
    windows = ws.windows
    if ws.untimed:
        windows = windows.select("name", "geom_id")
        joined = matched.join(F.broadcast(windows), "geom_id") if ws.small else salted_join(
            matched, windows, ["geom_id"], [fid])
        return joined.drop("geom_id")
    width = _bucket_seconds(ws.max_seconds)
    bucket = lambda c: F.floor(cells.unix_seconds(c) / F.lit(width)).cast("long")
    bounded = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    windows = windows.withColumn("_bucket", F.explode(
        F.when(bounded & (F.col("lo") <= F.col("hi")), F.sequence(bucket(F.col("lo")), bucket(F.col("hi"))))
        .when(~bounded, F.array(F.lit(OPEN_BUCKET)))))
    own = bucket(ts)
    probe = matched.withColumn("_bucket", F.explode(F.array(own, F.lit(OPEN_BUCKET))) if ws.open_ended else own)
    joined = (
        probe.join(F.broadcast(windows), ["geom_id", "_bucket"]) if ws.small
        else salted_join(probe, windows, ["geom_id", "_bucket"], [fid])
    )
    return joined.filter(in_span_columns(ts, F.col("lo"), F.col("hi"), F.col("closed"))).drop(
        "geom_id", "_bucket", "lo", "hi", "closed")


def points_in_windows(
    features: DataFrame, ws: WindowSet, time_col: str = "ts", lon: str = "lon", lat: str = "lat",
    mode: str = "exact", fid: str = "fid",
) -> DataFrame:
    """Rows of ``features`` with the ``name`` of each window they fall in (a row per window).

    ``mode="loose"`` keeps everything in a cell of the window's cover: extra rows, never fewer.
    """
    if ws.span.lo is not None or ws.span.hi is not None:
        features = features.filter(in_span(F.col(time_col), TimeSpan(ws.span.lo, ws.span.hi, True)))
    if not ws.spatial:
        return match_times(features.withColumn("geom_id", F.lit(EVERYWHERE)), ws, time_col, fid)
    return match_times(_match_shapes(features, ws, lon, lat, mode, fid), ws, time_col, fid)


def count_matches(matches: DataFrame, ws: WindowSet) -> DataFrame:
    """``name, n`` for every window, empty ones with 0."""
    if ws.rows and len(ws.rows) == 1:
        return matches.agg(F.count("*").alias("n")).select(F.lit(ws.rows[0].name).alias("name"), "n")
    counts = matches.groupBy("name").agg(F.count("*").alias("n"))
    # at most one row per window, so as bounded as the window table
    counts = F.broadcast(counts) if ws.small else counts
    return ws.windows.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def _in_one_span(features: DataFrame, ws: WindowSet, time_col: str) -> DataFrame:
    if ws.untimed:
        return features
    end = lambda v: F.lit(None).cast("timestamp_ntz") if v is None else ntz(v)
    lo, hi, closed = ws.one_span
    return features.filter(in_span(F.col(time_col), TimeSpan(lo, hi, True)) & in_span_columns(F.col(time_col), end(lo), end(hi), F.lit(closed)))


def _per_window(rows: DataFrame, ws: WindowSet) -> DataFrame:
    """A side of a join with a row per shape or window. Beyond the limits neither side is broadcast, whatever Spark guesses: it guesses
    the size of windows from the files they come from, without the rows that ``explode`` makes of one."""
    return rows if ws.small else rows.hint("merge")


def _sums_by_name(per_shape: DataFrame, ws: WindowSet, *columns: str) -> DataFrame:
    joined = ws.windows.select("name", "geom_id").join(_per_window(per_shape, ws), "geom_id")
    return joined.groupBy("name").agg(*[F.sum(c).alias(c) for c in columns])


def _named_counts(per_shape: DataFrame, ws: WindowSet) -> DataFrame:
    sums = _per_window(_sums_by_name(per_shape, ws, "n"), ws)
    return ws.windows.select("name").join(sums, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def count_in_windows(features: DataFrame, ws: WindowSet, time_col: str = "ts", **options) -> DataFrame:
    """``name, n`` for every window. Box windows held as data that ask for one time are counted without a row per match
    (:mod:`waymark.operators.ranges`), as their number may grow with the features."""
    if ws.one_span is None or options.get("mode", "exact") != "exact":
        return count_matches(points_in_windows(features, ws, time_col, **options), ws)
    x, y = F.col(options.get("lon", "lon")), F.col(options.get("lat", "lat"))
    asked = _in_one_span(features, ws, time_col).filter(geo.in_box(x, y, ws.envelope))
    return _named_counts(points_per_box(asked, ws.geoms, x, y), ws)


def count_extents_in_windows(extents: DataFrame, ws: WindowSet, time_col: str = "day", fid: str = "fid") -> DataFrame:
    """``name, n``: box features that meet each window, counted as in :func:`count_in_windows`."""
    if ws.one_span is None:
        return count_matches(extents_in_windows(extents, ws, time_col, fid), ws)
    return _named_counts(extents_per_box(_in_one_span(extents, ws, time_col), ws.geoms), ws)


def selectivity(features: DataFrame, ws: WindowSet, time_col: str = "ts", **options) -> DataFrame:
    """Per window: rows in the cells of its cover, rows that match, and the share read in vain.

    ``cells`` is the number of cells of the cover and ``span`` their share of the world grid.
    """
    level = F.pow(F.lit(4.0), F.col("level"))
    covers = ws.geoms.select("geom_id", cells.n_box_cells(
        F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("level")).alias("cells"), "level").withColumn(
        "span", F.col("cells") / level).drop("level")
    if ws.one_span is None:
        counts = points_in_windows(features, ws, time_col, mode="flag", **options).groupBy("name").agg(
            F.count("*").alias("candidates"), F.count_if("exact").alias("matches"))
    else:
        asked, x, y = _in_one_span(features, ws, time_col), F.col(options.get("lon", "lon")), F.col(options.get("lat", "lat"))
        matches = points_per_box(asked.filter(geo.in_box(x, y, ws.envelope)), ws.geoms, x, y, out="matches")
        per_shape = points_per_cover(asked, ws.geoms, x, y, ws.levels, out="candidates").join(_per_window(matches, ws), "geom_id", "left")
        counts = _sums_by_name(per_shape, ws, "candidates", "matches")
    counts, covers = (F.broadcast(counts), F.broadcast(covers)) if ws.small else (_per_window(counts, ws), _per_window(covers, ws))
    n, m = F.coalesce("candidates", F.lit(0)), F.coalesce("matches", F.lit(0))
    return ws.windows.select("name", "geom_id").join(covers, "geom_id").join(counts, "name", "left").select(
        "name", "cells", "span", n.alias("candidates"), m.alias("matches"),
        F.when(n > 0, (n - m) / n).otherwise(0.0).alias("extra"))


CELLS_PER_EXTENT = 64


def with_grid_keys(df: DataFrame, box: Sequence[Column], own_levels: Sequence[int], start: tuple[Column, Column] | None = None) -> DataFrame:
    """A row per chip ``key`` a feature with an extent must look at; ``holds_start`` marks its start's cell.

    For each level shapes are cut at, a feature that would cover too many cells there looks at a coarser
    level; :func:`multi_level_chips` holds every shape at the coarser levels too.
    """
    grid_levels = sorted({0, *own_levels})
    start = start or (box[0], box[1])

    def level_of(own: int) -> Column:
        usable = [g for g in grid_levels if g <= own]
        level = F.lit(usable[0])
        for g in usable[1:]:
            level = F.when(cells.n_box_cells(*box, g) <= CELLS_PER_EXTENT, F.lit(g)).otherwise(level)
        return level

    # one step per intermediate value, so that none is worked out again for every cell
    df = df.withColumns({f"_g{own}": level_of(own) for own in own_levels})
    corners = {}
    for own in own_levels:
        g = F.col(f"_g{own}")
        corners.update({
            f"_c{own}": F.struct(
                cells.cell_x(box[0], g).alias("x0"), cells.cell_y(box[1], g).alias("y0"), cells.cell_x(box[2], g).alias("x1"), cells.cell_y(box[3], g).alias("y1"),
                cells.cell_x(start[0], g).alias("sx"), cells.cell_y(start[1], g).alias("sy"),
                cells.cell_key(F.lit(own * 32) + g, F.lit(0).cast("long"), F.lit(0).cast("long")).alias("base"))})
    df = df.withColumns(corners)

    def keys(own: int) -> Column:
        c = F.col(f"_c{own}")
        rows = F.sequence(c["y0"], c["y1"])
        return F.flatten(F.transform(F.sequence(c["x0"], c["x1"]), lambda cx: F.transform(rows, lambda cy: F.struct(
            (c["base"] + cx * F.lit(2**24) + cy).alias("key"), ((cx == c["sx"]) & (cy == c["sy"])).alias("holds_start")))))

    probed = df.withColumn("_p", F.explode(F.concat(*[keys(own) for own in own_levels])))
    return probed.select("*", "_p.key", "_p.holds_start").drop("_p", *[f"_g{o}" for o in own_levels], *corners)


def multi_level_chips(ws: WindowSet) -> DataFrame:
    coarser = F.filter(F.array(*[F.lit(g) for g in sorted({0, *ws.levels})]), lambda g: g <= F.col("level"))
    return shape_chips(ws.geoms.withColumn("_grid", F.explode(coarser)), F.col("_grid"), F.col("level"))


def _box_meets_shape(own: Sequence[Column], level: Column, cx: Column, cy: Column) -> Column:
    """A box feature against the shape of a chip it shares a cell with."""
    # within a boundary cell: an edge meets the box, or the part of the box in the cell lies inside
    n = F.pow(F.lit(2.0), level)
    x = F.greatest(own[0], cx / n * 360.0 - 180.0)
    y = F.greatest(own[1], cy / n * 180.0 - 90.0)
    crossed = F.exists("near", lambda e: geo.segment_meets_box((e["x1"], e["y1"], e["x2"], e["y2"]), own))
    polygon = F.col("near").isNull() | crossed | geo.in_edges(x, y, F.col("near"))
    circle = F.col("metres").isNull() | geo.box_within_metres(own, F.col("mx"), F.col("my"), F.col("metres"))
    return F.when(F.col("polygon"), polygon).otherwise(circle)


def extents_in_windows(extents: DataFrame, ws: WindowSet, time_col: str = "day", fid: str = "fid") -> DataFrame:
    """``fid, name`` of box features (xmin, ymin, xmax, ymax) that meet the windows' boxes, polygons or buffers, edges included."""
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    ends = ws.span.lo is not None or ws.span.hi is not None
    if ends:
        extents = extents.filter(in_span(F.col(time_col), TimeSpan(ws.span.lo, ws.span.hi, True)))
    if not ws.spatial:
        return match_times(extents.select(fid, time_col, F.lit(EVERYWHERE).alias("geom_id")), ws, time_col, fid).select(fid, "name")
    keyed = with_grid_keys(extents.select(fid, time_col, *box), box, ws.levels).select(
        fid, time_col, *[c.alias(f"f_{n}") for c, n in zip(box, ("xmin", "ymin", "xmax", "ymax"))], "key")
    chips = multi_level_chips(ws)
    joined = keyed.join(F.broadcast(chips), "key") if ws.small else salted_join(keyed, chips, ["key"], [fid])
    own = [F.col(f"f_{n}") for n in ("xmin", "ymin", "xmax", "ymax")]
    # a box window that shares several cells counts only in the cell of the lower left corner of the common part
    tag = F.floor(F.col("key") / F.lit(2**48))
    level = (tag % 32).cast("int")
    corner = cells.cell_key(tag, cells.cell_x(F.greatest(own[0], box[0]), level), cells.cell_y(F.greatest(own[1], box[1]), level))
    cx, cy = F.floor(F.col("key") / F.lit(2**24)) % F.lit(2**24), F.col("key") % F.lit(2**24)
    met = joined.filter(geo.boxes_meet(own, box) & (F.col("polygon") | (corner == F.col("key"))) & _box_meets_shape(own, level, cx, cy))
    met = met.select(fid, time_col, "geom_id")
    if ws.has_polygons:  # the cells of a polygon are tested one by one
        met = met.distinct()
    return match_times(met, ws, time_col, fid).select(fid, "name")
