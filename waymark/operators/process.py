"""Processes over feature tables: density, statistics, nearness, thinning, text search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waymark.functions import cells, draws, geo
from waymark.operators.skew import join_measured, null_safe_join, salted_join
from waymark.session import cut_lineage


# ---- density and statistics ----------------------------------------------------------------------

def heatmap(df: DataFrame, level: int, weight: Column | None = None) -> DataFrame:
    """Count and weight per grid cell."""
    return df.groupBy(cells.cell_x(F.col("lon"), level).alias("cx"), cells.cell_y(F.col("lat"), level).alias("cy")).agg(
        F.count("*").alias("n"), F.sum(weight if weight is not None else F.lit(1.0)).alias("weight"))


def kernel_density(df: DataFrame, level: int, bandwidth: float, radius: int) -> DataFrame:
    """Gaussian density at cell centres: cell counts are spread over the cells within ``radius``.

    ``bandwidth`` is in cells. Only the counted cells are spread, not the features.
    """
    reach = F.sequence(F.lit(-radius), F.lit(radius)).cast("array<bigint>")
    counted = heatmap(df, level).select("cx", "cy", "n")
    spread = counted.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach))
    share = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.lit(2.0 * bandwidth * bandwidth))
    side = 2**level - 1
    return (
        spread.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("n") * share).alias("v"))
        .filter(F.col("cx").between(0, side) & F.col("cy").between(0, side))
        .groupBy("cx", "cy").agg(F.sum("v").alias("density"))
    )


def enumeration(df: DataFrame, attribute: str) -> DataFrame:
    return df.groupBy(attribute).agg(F.count("*").alias("n"))


def bounds(df: DataFrame, attribute: str) -> DataFrame:
    return df.agg(F.count(attribute).alias("n"), F.min(attribute).alias("min"), F.max(attribute).alias("max"))


def value_histogram(df: DataFrame, attribute: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width bins 1..n; 0 and n + 1 hold what lies outside."""
    return df.select(F.width_bucket(attribute, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def top_k(df: DataFrame, attribute: str, k: int) -> DataFrame:
    return enumeration(df, attribute).orderBy(F.desc("n"), attribute).limit(k)


def frequency_sketch(df: DataFrame, attribute: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 7) -> DataFrame:
    return df.agg(F.count_min_sketch(attribute, F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def _sketch_buckets(attribute: str, depth: int, width: int) -> Column:
    """One struct (line, bucket) per line of a count-min table, from the leading digits of a digest."""
    digit = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(f"{i}|"), F.col(attribute).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.inline(F.array(*[F.struct(F.lit(i).alias("line"), (digit(i) % width).alias("bucket")) for i in range(depth)]))


def frequency_table(df: DataFrame, attribute: str, depth: int = 4, width: int = 1024) -> DataFrame:
    """Count-min counts ``line, bucket, n``: ``depth * width`` rows at most, however many values there are."""
    return df.filter(F.col(attribute).isNotNull()).select(_sketch_buckets(attribute, depth, width)).groupBy("line", "bucket").agg(F.count("*").alias("n"))


def frequency_estimates(values: DataFrame, counts: DataFrame, attribute: str, depth: int = 4, width: int = 1024) -> DataFrame:
    """The estimated count of each given value: never below the true one."""
    asked = values.select(attribute, _sketch_buckets(attribute, depth, width))
    met = asked.join(F.broadcast(counts), ["line", "bucket"], "left")  # at most depth * width rows
    return met.groupBy(attribute).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


# ---- nearness ------------------------------------------------------------------------------------

def nearest_to_point(df: DataFrame, lon: float, lat: float, k: int, fid: str = "fid") -> DataFrame:
    """The k nearest features in map metres; each task keeps its own k best."""
    mx, my = geo.merc_xy(lon, lat)
    d = F.hypot(geo.merc_x(F.col("lon")) - F.lit(mx), geo.merc_y(F.col("lat")) - F.lit(my))
    return df.withColumn("metres", d).orderBy("metres", fid).limit(k)


def nearest_centre(df: DataFrame, centres: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Add the nearest centre's name (degrees, smaller name on a tie). Centres are job parameters."""
    options = F.array(*[
        F.struct((F.pow(F.col("lon") - x, 2) + F.pow(F.col("lat") - y, 2)).alias("d"), F.lit(name).alias("name"))
        for name, x, y in centres])
    return df.withColumn("centre", F.array_min(options)["name"])


def within_distance_of_any(a: DataFrame, b: DataFrame, metres: float, pair_limit: int = 4_000_000) -> DataFrame:
    """Rows of ``a`` with any point of ``b`` within map metres.

    The occupied cells of both sides meet first. A pair of cells whose farthest corners are within reach
    settles all its points at once, and a pair whose nearest corners are out of reach is dropped. Points are
    compared only across the pairs between, once per distinct place. If such a pair would need more than
    ``pair_limit`` comparisons the cells are made finer; the result is the same for any cell size.
    """
    for fine in (2**0.5 * (1 + 1e-9), 4.0, 8.0, 16.0):
        side = metres / fine
        left, right = _in_cells(a, side), _in_cells(b, side).select("_cx", "_cy", "_mx", "_my").distinct()
        reach = int(-(-fine // 1)) + 1
        gaps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)
                if max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= fine**2 * (1 + 1e-9)]
        offsets = F.array(*[
            F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit((abs(i) + 1) ** 2 + (abs(j) + 1) ** 2 <= fine**2 * (1 - 1e-12)).alias("sure"))
            for i, j in gaps])
        a_cells = left.groupBy("_cx", "_cy").agg(F.count("*").alias("na")).select("_cx", "_cy", "na", F.inline(offsets)).select(
            "_cx", "_cy", "na", "sure", (F.col("_cx") + F.col("dx")).alias("_bx"), (F.col("_cy") + F.col("dy")).alias("_by"))
        b_cells = right.groupBy(F.col("_cx").alias("_bx"), F.col("_cy").alias("_by")).agg(F.count("*").alias("nb"))
        pairs = cut_lineage(a_cells.join(b_cells, ["_bx", "_by"]))
        sure_cells = cut_lineage(pairs.filter("sure").select("_cx", "_cy").distinct())
        open_pairs = pairs.join(sure_cells, ["_cx", "_cy"], "left_anti").drop("sure")
        most = open_pairs.agg(F.max(F.col("na") * F.col("nb"))).first()[0]
        if most is None or most <= pair_limit:
            break
    settled = left.join(sure_cells, ["_cx", "_cy"], "left_semi")
    unsure = left.join(open_pairs.select("_cx", "_cy").distinct(), ["_cx", "_cy"], "left_semi")
    candidates = open_pairs.select("_cx", "_cy", "_bx", "_by").join(
        right.select(F.col("_cx").alias("_bx"), F.col("_cy").alias("_by"), F.col("_mx").alias("_px"), F.col("_my").alias("_py")), ["_bx", "_by"])
    places = unsure.select("_cx", "_cy", "_mx", "_my").distinct()
    dx, dy = F.col("_mx") - F.col("_px"), F.col("_my") - F.col("_py")
    hits = salted_join(places, candidates, ["_cx", "_cy"], ["_mx", "_my"]).filter(
        dx * dx + dy * dy <= F.lit(metres * metres)).select("_cx", "_cy", "_mx", "_my").distinct()
    found = unsure.join(hits, ["_cx", "_cy", "_mx", "_my"], "left_semi")
    return settled.select(*a.columns).unionByName(found.select(*a.columns))


def _in_cells(df: DataFrame, side: float) -> DataFrame:
    moved = df.withColumn("_mx", geo.merc_x(F.col("lon"))).withColumn("_my", geo.merc_y(F.col("lat")))
    return moved.withColumn("_cx", F.floor(F.col("_mx") / F.lit(side))).withColumn("_cy", F.floor(F.col("_my") / F.lit(side)))


def nearest_neighbours(df: DataFrame, fid: str = "fid", cell_limit: int = 16, step: int = 4) -> DataFrame:
    """``fid, nn, d2``: the nearest other feature by planar distance in degrees, smallest id on a tie.

    Copies at one place are settled by counting. Distinct places look in the 3 x 3 cells around them, from
    fine cells to coarse ones: a neighbour no farther than the cell side is the nearest one, and the place
    leaves the search. Places still searching are farther apart than the previous cell side, so few of
    them share a coarse cell and the work per round stays proportional to the number of places.
    """
    points = df.select(F.col(fid).alias("fid"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    first = points.groupBy("x", "y").agg(F.min("fid").alias("first"), F.count("*").alias("n"))
    repeated = first.filter("n > 1").select("x", "y", "first")
    copies = join_measured(points, repeated, ["x", "y"], ["fid"])
    second = copies.filter(F.col("fid") != F.col("first")).groupBy("x", "y", "first").agg(F.min("fid").alias("second"))
    settled = join_measured(points, second, ["x", "y"], ["fid"]).select(
        "fid", F.when(F.col("fid") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("nn"), F.lit(0.0).alias("d2"))
    parts = [settled]

    places = cut_lineage(first.select("x", "y", "first", "n"))
    n_places = places.count()
    if n_places < 2:
        return settled
    bits = max(1, n_places.bit_length() // 2)
    cell = lambda v, low, s: F.floor((v - F.lit(low)) / F.lit(s))
    while bits < 40:
        side = 360.0 / 2**bits
        fullest = places.groupBy(cell(F.col("x"), -180.0, side), cell(F.col("y"), -90.0, side)).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        if fullest <= cell_limit:
            break
        bits += 2
    open_places, side = places.filter("n = 1"), 360.0 / 2**bits
    around = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    while True:
        keyed = places.select(cell(F.col("x"), -180.0, side).alias("cx"), cell(F.col("y"), -90.0, side).alias("cy"),
                              F.col("x").alias("px"), F.col("y").alias("py"), F.col("first").alias("pf"))
        search = open_places.withColumn("ix", F.explode(around)).withColumn("iy", F.explode(around)).select(
            (cell(F.col("x"), -180.0, side) + F.col("ix")).alias("cx"), (cell(F.col("y"), -90.0, side) + F.col("iy")).alias("cy"), "x", "y", F.col("first").alias("fid"))
        dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
        near = salted_join(keyed, search, ["cx", "cy"], ["px", "py"]).filter(F.col("pf") != F.col("fid")).groupBy("fid").agg(
            F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("pf").alias("nn"))).alias("best"))
        last = side >= 360.0
        done = near if last else near.filter(F.col("best.d2") <= F.lit(side * side))
        done = cut_lineage(done.select("fid", "best.nn", "best.d2"))
        parts.append(done)
        open_places = cut_lineage(open_places.join(done, open_places["first"] == done["fid"], "left_anti"))
        if last or open_places.isEmpty():
            break
        side *= step
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tube_select(
    features: DataFrame, segments: DataFrame, metres: float, max_speed: float, bucket_seconds: int = 3600,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """``fid, track``: features within map metres of where a moving track is at the feature's time.

    The position between two track points is interpolated. Segments faster than ``max_speed`` (map metres
    per second) are left out. Segments are cut at time buckets, so each piece covers few cells.
    """
    side = metres * 4
    secs = lambda c: cells.unix_millis(F.col(c)) / F.lit(1000.0)
    s = segments.select(
        "track", secs("t1").alias("s1"), secs("t2").alias("s2"), geo.merc_x(F.col("x1")).alias("ax"), geo.merc_y(F.col("y1")).alias("ay"),
        geo.merc_x(F.col("x2")).alias("bx"), geo.merc_y(F.col("y2")).alias("by"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    s = s.filter((F.col("s2") > F.col("s1")) & (length <= F.lit(float(max_speed)) * (F.col("s2") - F.col("s1"))))
    w = float(bucket_seconds)
    s = s.withColumn("b", F.explode(F.sequence(F.floor(F.col("s1") / w), F.floor(F.col("s2") / w))))
    part = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - F.col("s1")) / (F.col("s2") - F.col("s1"))))
    p, q = part(F.col("b") * w), part((F.col("b") + 1) * w)
    at = lambda a, b, r: F.col(a) + (F.col(b) - F.col(a)) * r
    cell = lambda v: F.floor(v / F.lit(side))
    pad = F.lit(metres * (1 + 1e-9) + 1e-3)
    span = lambda a, b: F.sequence(
        cell(F.least(at(a, b, p), at(a, b, q)) - pad), cell(F.greatest(at(a, b, p), at(a, b, q)) + pad))
    s = s.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    f = features.select(
        "fid", secs("ts").alias("t"), geo.merc_x(F.col("lon")).alias("fx"), geo.merc_y(F.col("lat")).alias("fy")).withColumns({
            "b": F.floor(F.col("t") / w), "cx": cell(F.col("fx")), "cy": cell(F.col("fy"))})
    r = (F.col("t") - F.col("s1")) / (F.col("s2") - F.col("s1"))
    dx, dy = F.col("fx") - at("ax", "bx", r), F.col("fy") - at("ay", "by", r)
    key = ["b", "cx", "cy"]

    def met(rows: DataFrame) -> DataFrame:
        joined = salted_join(rows, s, key, ["fid"], rows_per_task=rows_per_task)
        near = joined.filter(F.col("t").between(F.col("s1"), F.col("s2")) & (dx * dx + dy * dy <= F.lit(metres * metres)))
        # with the key of the join, so that repeated pairs go where they arise and are not shuffled
        return near.select(*key, "fid", "track").distinct().select("fid", "track")

    # an id at one time and place meets a track under one key; repeated ids at several do not
    several = cut_lineage(f.groupBy("fid").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("z")).filter(F.col("a") != F.col("z")).select("fid"))
    if several.isEmpty():
        return met(f)
    apart = [null_safe_join(f, several, ["fid"], how) for how in ("left_anti", "left_semi")]
    return met(apart[0]).unionByName(met(apart[1]).distinct())


# ---- choice --------------------------------------------------------------------------------------

def sample_overall(df: DataFrame, k: int, seed: int, fid: str = "fid") -> DataFrame:
    """k random features: the k smallest hashes of seed and id."""
    return df.withColumn("_h", draws._digest(seed, "sample", F.col(fid))).orderBy("_h", fid).limit(k).drop("_h")


def sample_per_group(df: DataFrame, group: str, k: int, seed: int, fid: str = "fid") -> DataFrame:
    """k random features of each group. Spark keeps only k rows per group and task before it shuffles."""
    h = df.withColumn("_h", draws._digest(seed, "sample", F.col(fid)))
    w = Window.partitionBy(group).orderBy("_h", fid)
    return h.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_h", "_r")


def thin_to_pixels(df: DataFrame, box, width: int, height: int, fid: str = "fid") -> DataFrame:
    """One feature (the smallest id) per output pixel of a map window."""
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    px = F.least(F.floor((F.col("lon") - xmin) / (xmax - xmin) * float(width)), F.lit(width - 1))
    py = F.least(F.floor((F.lit(ymax) - F.col("lat")) / (ymax - ymin) * float(height)), F.lit(height - 1))
    inside = df.filter(geo.in_box(F.col("lon"), F.col("lat"), (xmin, ymin, xmax, ymax)))
    return inside.groupBy(px.alias("px"), py.alias("py")).agg(F.min(F.struct(F.col(fid).alias("fid"), "lon", "lat")).alias("f")).select(
        "px", "py", "f.*")


def meeting_interval(df: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Features whose own interval meets the asked one."""
    return df.filter((F.col(start) <= hi) & (F.col(end) >= lo))


# ---- attribute and text lookup -------------------------------------------------------------------

def write_attribute_index(df: DataFrame, path: str, attribute: str, fid: str = "fid", full: bool = True) -> None:
    """A copy clustered by the attribute: whole records, or only attribute and id. ``fid`` in the range
    key lets a frequent value spread over many files."""
    rows = df if full else df.select(attribute, fid)
    rows.repartitionByRange(attribute, fid).sortWithinPartitions(attribute, fid).write.mode("append").parquet(path)


def lookup_full(spark: SparkSession, path: str, attribute: str, value) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(attribute) == value)


def lookup_join(spark: SparkSession, path: str, records: DataFrame, attribute: str, value, fid: str = "fid") -> DataFrame:
    ids = lookup_full(spark, path, attribute, value).select(fid)
    return join_measured(records, ids.distinct(), [fid], [fid], "left_semi")


def ngrams(text: Column, n: int = 3) -> Column:
    lowered = F.lower(text)
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(lowered) - (n - 1), F.lit(1))), lambda i: F.substr(lowered, i, F.lit(n))))


def ngram_index(df: DataFrame, text: str, fid: str = "fid", n: int = 3) -> DataFrame:
    return df.select(fid, F.explode(ngrams(F.col(text), n)).alias("gram"))


def ngram_search(df: DataFrame, index: DataFrame, text: str, pattern: str, fid: str = "fid", n: int = 3) -> DataFrame:
    """Features whose text contains the pattern, letter case aside.

    Ids with every gram of the pattern are candidates; the text decides. Patterns shorter than n are not
    in the index and scan the text.
    """
    pattern = pattern.lower()
    grams = sorted({pattern[i:i + n] for i in range(len(pattern) - n + 1)})
    hit = F.lower(F.col(text)).contains(pattern)
    if not grams:
        return df.filter(hit)
    ids = index.filter(F.col("gram").isin(grams)).groupBy(fid).agg(F.count("*").alias("_g")).filter(F.col("_g") == len(grams))
    return join_measured(df, ids.select(fid), [fid], [fid], "left_semi").filter(hit)
