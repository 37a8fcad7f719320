"""Generated features from instruction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.functions import draws


def expand_instructions(instructions: DataFrame, key: str, tasks: str = "tasks") -> DataFrame:
    """A row per instruction and task with its own ``seed``."""
    return instructions.withColumn("task", F.explode(F.sequence(F.lit(1), F.col(tasks)))).withColumn(
        "seed", F.concat_ws("-", F.col(key).cast("string"), F.col("task").cast("string")))


def generate_points(
    tasks: DataFrame, lng: tuple, lat: tuple, time: tuple, n: str, seed: str = "seed", attributes: bool = True,
) -> DataFrame:
    """``n`` points per task: fid ``seed/i``, place and time from distributions, random attributes."""
    numbered = tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    i, s = F.col("i"), F.col(seed)
    out = numbered.withColumns({
        "fid": F.concat_ws("/", s, F.concat(F.lit("i="), i.cast("string"))),
        "lon": draws.draw(lng, s, "lng", i), "lat": draws.draw(lat, s, "lat", i),
        "when": F.timestamp_millis(F.floor(draws.draw(time, s, "time", i))).cast("timestamp_ntz"),
    })
    return with_attributes(out, seed, "i") if attributes else out


def generate_extents(
    tasks: DataFrame, lng: tuple, lat: tuple, lo: float, hi: float, step: float, n: str, seed: str = "seed",
) -> DataFrame:
    """Squares of widths lo, lo + step, .. below hi, ``n`` of each, cut at the edge of the world.

    The corner is drawn in [-180, 180] x [-90, 90]; it is not moved to the positive quarter.
    """
    count = max(0, -int(-(hi - lo) // step))
    numbered = (
        tasks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        .withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .withColumn("width", F.lit(float(lo)) + F.col("w") * F.lit(float(step)))
    )
    s, i, w = F.col(seed), F.col("i"), F.col("w")
    corner = numbered.withColumn("xmin", F.greatest(draws.draw(lng, s, "lng", i, w), F.lit(-180.0))).withColumn(
        "ymin", F.greatest(draws.draw(lat, s, "lat", i, w), F.lit(-90.0)))
    return corner.withColumns({
        "fid": F.concat_ws("/", s, F.concat(F.lit("i="), i.cast("string")), F.concat(F.lit("w="), w.cast("string"))),
        "xmax": F.least(F.col("xmin") + F.col("width"), F.lit(180.0)),
        "ymax": F.least(F.col("ymin") + F.col("width"), F.lit(90.0)),
    })


def with_attributes(df: DataFrame, seed: str, key: str) -> DataFrame:
    """Random texts of 3, 7 and 13 letters."""
    s, k = F.col(seed), F.col(key)
    return df.withColumns({
        "who": draws.letters(s, "who", 3, k), "what": draws.letters(s, "what", 7, k), "why": draws.letters(s, "why", 13, k)})
