"""Aggregates, windows and filters over track points (track, tp, t, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order():
    """Points of a track in time order."""
    return Window.partitionBy("track").orderBy("tp")


SUMMARIES = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "absmean": lambda c: F.avg(F.abs(c)),
    "absmedian": lambda c: F.median(F.abs(c)),
}


def step(points: DataFrame) -> Column:
    """Distance from the point before, 0 at a track's first point."""
    return F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order()), F.col("y") - F.lag("y").over(order())), F.lit(0.0))


def geometry(points: DataFrame) -> DataFrame:
    """Points, arc length, displacement, straightness and bounding box of each track."""
    at = lambda c, f: f(c, "tp")
    rows = points.withColumn("step", step(points)).groupBy("track").agg(
        F.count("*").alias("n"), F.sum("step").alias("distance"),
        F.hypot(at("x", F.max_by) - at("x", F.min_by), at("y", F.max_by) - at("y", F.min_by)).alias("displacement"),
        *[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))],
    )
    return rows.withColumn("straightness", F.when(F.col("distance") > 0, F.col("displacement") / F.col("distance")))


def quality(points: DataFrame, min_samples: int = 5, min_distance: float = 1, min_displacement: float = 1) -> DataFrame:
    """Geometry of the tracks that are long enough in points, path and displacement."""
    return geometry(points).filter((F.col("n") >= min_samples) & (F.col("distance") >= min_distance) & (F.col("displacement") >= min_displacement))


def velocity(points: DataFrame) -> DataFrame:
    """dt, dx, dy, speed and heading to the next point; the last point of a track has none."""
    rows = points.select("track", "tp", *[(F.lead(c).over(order()) - F.col(c)).alias(f"d{c}") for c in "txy"]).filter("dt is not null")
    return rows.withColumn("speed", F.when(F.col("dt") > 0, F.hypot("dx", "dy") / F.col("dt"))).withColumn("heading", F.atan2("dy", "dx"))


def motion(points: DataFrame) -> DataFrame:
    """Displacement from the first point, path so far and their ratio."""
    run = order().rowsBetween(Window.unboundedPreceding, 0)
    start = [F.first(c).over(run) for c in "xy"]
    rows = points.withColumn("step", step(points)).select("track", "tp", F.hypot(F.col("x") - start[0], F.col("y") - start[1]).alias("displacement"), F.sum("step").over(run).alias("distance"))
    return rows.withColumn("ratio", F.when(F.col("distance") > 0, F.col("displacement") / F.col("distance")))


def summary(points: DataFrame, field: str, functions: tuple[str, ...] = tuple(SUMMARIES)) -> DataFrame:
    return points.groupBy("track").agg(*[SUMMARIES[f](field).alias(f"{field}_{f}") for f in functions])


def in_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Tracks whose bounding box overlaps the given one."""
    return geometry(points).filter((F.col("x_max") >= x0) & (F.col("x_min") <= x1) & (F.col("y_max") >= y0) & (F.col("y_min") <= y1))


def longest(points: DataFrame, most: int, max_speed: float) -> DataFrame:
    """The tracks with most points among those that never move faster than ``max_speed``."""
    fast = velocity(points).filter(F.col("speed") > max_speed).select("track").distinct()
    return points.groupBy("track").agg(F.count("*").alias("n")).join(fast, "track", "left_anti").orderBy(F.desc("n"), "track").limit(most)


def time_range(points: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Points from ``first`` to ``last``, ends included; None or a negative bound is open."""
    for bound, keep in ((first, lambda b: F.col("tp") >= b), (last, lambda b: F.col("tp") <= b)):
        if bound is not None and bound >= 0:
            points = points.filter(keep(bound))
    return points


def rolling_value(field: str, window: int) -> Column:
    """Centred rolling mean of a track's ``field`` whose ends repeat the first and last value."""
    before, after = window // 2, window - 1 - window // 2
    span, whole = order().rowsBetween(-before, after), Window.partitionBy("track")
    place, n = F.row_number().over(order()), F.count("*").over(whole)
    short = F.greatest(F.lit(0), F.lit(before + 1) - place), F.greatest(F.lit(0), place + after - n)
    ends = F.min_by(field, "tp").over(whole), F.max_by(field, "tp").over(whole)
    return (F.sum(field).over(span) + short[0] * ends[0] + short[1] * ends[1]) / window


def rolling_mean(points: DataFrame, window: int, field: str) -> DataFrame:
    """``rolling_value`` of each point: (track, tp, field_mean)."""
    return points.select("track", "tp", rolling_value(field, window).alias(f"{field}_mean"))


def frame_means(points: DataFrame, scale: float, field: str) -> DataFrame:
    """Mean of dense samples in each frame [k * scale, (k + 1) * scale)."""
    return points.groupBy("track", F.floor(F.col("t") / scale).alias("frame")).agg(F.avg(field).alias(f"{field}_mean"), F.count("*").alias("n"))


def aligned(series: DataFrame) -> DataFrame:
    """(series, tp, value) on one complete timeline: missing places are null."""
    line = series.agg(F.explode(F.sequence(F.min("tp"), F.max("tp"))).alias("tp"))
    names = series.select("series").distinct()
    return names.crossJoin(F.broadcast(line)).join(series, ["series", "tp"], "left")


def scaled(points: DataFrame, factor: float, decimals: int = 6) -> DataFrame:
    """Tracks scaled about the mean of their points, the mean rounded to ``decimals``, so that it doesn't depend on the order of summing."""
    own = Window.partitionBy("track")
    mean = {c: F.round(F.avg(c).over(own), decimals) for c in "xy"}
    return points.select("track", "tp", *[(mean[c] + (F.col(c) - mean[c]) * factor).alias(c) for c in "xy"])


def radial_motion(points: DataFrame) -> DataFrame:
    """``motion`` with velocity and speed: displacement and path by the time since the first point; null there."""
    run = order().rowsBetween(Window.unboundedPreceding, 0)
    since = points.select("track", "tp", (F.col("t") - F.first("t").over(run)).alias("since"))
    by = lambda c: F.when(F.col("since") > 0, F.col(c) / F.col("since"))
    return motion(points).join(since, ["track", "tp"]).withColumns({"velocity": by("displacement"), "speed": by("distance")}).drop("since")


def axis_velocity(points: DataFrame) -> DataFrame:
    """(track, tp, vx, vy, v) from each point to the next; a track of one point has one row of zeros."""
    n = F.count("*").over(Window.partitionBy("track"))
    dt = F.lead("t").over(order()) - F.col("t")
    rate = lambda c: F.when(n == 1, 0.0).when(dt > 0, (F.lead(c).over(order()) - F.col(c)) / dt)
    rows = points.select("track", "tp", rate("x").alias("vx"), rate("y").alias("vy"), n.alias("n"), dt.alias("dt")).filter((F.col("n") == 1) | F.col("dt").isNotNull())
    return rows.select("track", "tp", "vx", "vy", F.hypot("vx", "vy").alias("v"))
