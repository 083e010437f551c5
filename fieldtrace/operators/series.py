"""Series of tracks: unwrapped angles, smoothing, even timelines, waveforms, adjacent frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracks import order


def unwrapped(angles: DataFrame, field: str) -> DataFrame:
    """``field`` (radians) without jumps of more than half a turn between neighbours, in degrees."""
    return with_unwrapped(angles, field).select("track", "tp", "angle")


def with_unwrapped(angles: DataFrame, field: str) -> DataFrame:
    """``angles`` with the unwrapped field as ``angle``."""
    turns = F.coalesce(F.round((F.col(field) - F.lag(field).over(order())) / (2 * math.pi)), F.lit(0.0))
    rows = angles.withColumn("turns", turns)
    return rows.withColumn("angle", F.degrees(F.col(field) - 2 * math.pi * F.sum("turns").over(order().rowsBetween(Window.unboundedPreceding, 0)))).drop("turns")


def gaussian(points: DataFrame, field: str, sigma: float = 1.0) -> DataFrame:
    """Gaussian mean of ``field`` out to four deviations; beyond its ends a track is mirrored. ``tp`` counts from 0 without gaps."""
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-reach, reach + 1)]
    n = F.count("*").over(Window.partitionBy("track"))
    spread = points.select("track", "tp", n.alias("n")).select("track", "tp", "n", F.posexplode(F.array(*[F.lit(w / sum(weights)) for w in weights])).alias("k", "weight"))
    place = F.pmod(F.col("tp") + F.col("k") - reach, 2 * F.col("n"))
    spread = spread.withColumn("place", F.when(place < F.col("n"), place).otherwise(2 * F.col("n") - 1 - place))
    values = points.select("track", F.col("tp").cast("long").alias("place"), F.col(field).alias("value"))
    return spread.join(values, ["track", "place"]).groupBy("track", "tp").agg(F.sum(F.col("weight") * F.col("value")).alias(f"{field}_smooth"))


def even(points: DataFrame, time: str, fields: list[str]) -> DataFrame:
    """Linear values of ``fields`` at the whole times of each track, its last time included; (track, frame, fields)."""
    own = Window.partitionBy("track").orderBy("tp")
    t = F.col(time)
    rows = points.select("track", t.alias("t0"), F.lead(t).over(own).alias("t1"), *fields, *[F.lead(c).over(own).alias(f"{c}_next") for c in fields])
    last = F.when(F.col("t1").isNull(), F.floor("t0")).otherwise(F.ceil("t1") - 1)
    rows = rows.withColumn("first", F.ceil("t0")).withColumn("last", last).filter("first <= last")
    rows = rows.withColumn("frame", F.explode(F.sequence("first", "last")))
    part = F.coalesce((F.col("frame") - F.col("t0")) / (F.col("t1") - F.col("t0")), F.lit(0.0))
    return rows.select("track", "frame", *[(F.col(c) + (F.coalesce(F.col(f"{c}_next"), F.col(c)) - F.col(c)) * part).alias(c) for c in fields])


def waveforms(points: DataFrame, field: str, most: int, step: float) -> DataFrame:
    """Series of the ``most`` tracks of widest range, each lifted by its rank times ``step``; one-point tracks are skipped."""
    wide = points.groupBy("track").agg((F.max(field) - F.min(field)).alias("range"), F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("range"), "track").limit(most)
    ranked = wide.select("track", (F.row_number().over(Window.orderBy(F.desc("range"), "track")) - 1).alias("rank"))
    return points.join(F.broadcast(ranked), "track").select("track", "rank", "tp", (F.coalesce(field, F.lit(0.0)) + F.col("rank") * step).alias(field))


def adjacent(records: DataFrame, series: list[str], time: str) -> DataFrame:
    """Records of a series whose whole times differ by one: (series, time, next)."""
    later = F.lead(time).over(Window.partitionBy(*series).orderBy(time))
    return records.select(*series, time, later.alias("next")).filter(F.col("next") - F.col(time) == 1)


def timeline_complement(points: DataFrame, *listed: DataFrame) -> DataFrame:
    """Points (tp, pt) in none of the lists, in the frames that any list names."""
    union = listed[0].select("tp", "pt")
    for more in listed[1:]:
        union = union.union(more.select("tp", "pt"))
    union = union.distinct()
    return points.select("tp", "pt").join(union.select("tp").distinct(), "tp", "left_semi").join(union, ["tp", "pt"], "left_anti")


def padded(values: DataFrame, field: str, first: int, last: int, extrapolate: bool = False) -> DataFrame:
    """(track, frame, field) on all whole times ``first`` to ``last``, from values at whole times (track, frame, field).

    Between two known times values are linear; outside a track they are null, or its end value where ``extrapolate``.
    """
    known = values.filter(F.col(field).isNotNull()).select("track", "frame", F.col(field).alias("v"))
    span = Window.partitionBy("track").orderBy("frame")
    rows = known.withColumn("next", F.lead("frame").over(span)).withColumn("v_next", F.lead("v").over(span)).withColumn("before", F.lag("frame").over(span))
    start = F.when(F.col("before").isNull() & F.lit(extrapolate), F.least(F.lit(first), "frame")).otherwise(F.col("frame"))
    stop = F.when(F.col("next").isNotNull(), F.col("next") - 1).otherwise(F.greatest(F.lit(last), "frame") if extrapolate else F.col("frame"))
    part = F.when(F.col("next").isNotNull() & (F.col("at") > F.col("frame")), (F.col("v_next") - F.col("v")) * (F.col("at") - F.col("frame")) / (F.col("next") - F.col("frame"))).otherwise(0.0)
    filled = rows.withColumn("at", F.explode(F.sequence(start, stop))).filter(F.col("at").between(first, last)).select("track", F.col("at").alias("frame"), (F.col("v") + part).alias(field))
    if extrapolate:
        return filled
    every = known.select("track").distinct().withColumn("frame", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return every.join(filled, ["track", "frame"], "left")


def joined_tracks(points: DataFrame, joins: DataFrame) -> DataFrame:
    """Points under new track ids, from joins (track, head): a track that no join names keeps its own."""
    return points.join(joins.select("track", "head"), "track", "left").withColumn("track", F.coalesce("head", "track")).drop("head")


def persistence_timeline(points: DataFrame, flag: str, width: float) -> DataFrame:
    """Share of the points of each stretch of ``width`` in time that bear ``flag``, with their number: (stretch, share, n)."""
    return points.filter(F.col(flag).isNotNull()).groupBy(F.floor(F.col("t") / width).alias("stretch")).agg(F.avg(F.col(flag).cast("double")).alias("share"), F.count("*").alias("n"))


def padded_boxes(points: DataFrame, pad: float, width: float, height: float) -> DataFrame:
    """Whole-number box of each track, ``pad`` wider on all sides, cut to the image: (track, x0, y0, x1, y1)."""
    low = lambda c: F.greatest(F.floor(F.min(c)) - pad, F.lit(0.0)).cast("double")
    high = lambda c, end: F.least(F.ceil(F.max(c)) + pad, F.lit(end)).cast("double")
    return points.groupBy("track").agg(low("x").alias("x0"), low("y").alias("y0"), high("x", float(width)).alias("x1"), high("y", float(height)).alias("y1"))


def key_times(points: DataFrame) -> DataFrame:
    """First, middle (rounded) and last but one whole times of the frames, in one row; with two frames or fewer the last itself."""
    ends = points.agg(F.min("tp").alias("first"), F.max("tp").alias("last"))
    return ends.select("first", F.round((F.col("first") + F.col("last")) / 2).cast("int").alias("middle"), F.when(F.col("last") - F.col("first") > 1, F.col("last") - 1).otherwise(F.col("last")).alias("late"))


def filled_tracks(points: DataFrame, joins: DataFrame) -> DataFrame:
    """(track, frame, x, y): tracks joined under their head (track, head), with linear places at the whole times between two points; of
    two points of one time the one of the lesser track stays."""
    rows = points.join(joins, "track", "left").select(F.coalesce("head", "track").alias("head"), "track", "tp", "x", "y")
    one = rows.groupBy("head", "tp").agg(F.min_by(F.struct("x", "y"), "track").alias("p")).select(F.col("head").alias("track"), "tp", "p.x", "p.y")
    return even(one, "tp", ["x", "y"])
