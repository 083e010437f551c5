"""Summaries and reports over tracks, categories and compartments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resampling
from .groups import PERCENTILES, category_summary
from .inference import bootstrap_interval
from .tracks import order


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to 1 that the parts fix, as SQL can repeat it."""
    text = F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / (1 << 32)


def envelope(rows: DataFrame, keys: list[str], value: str, kind: str) -> DataFrame:
    """Centre and band of each key; one value has no band, none no row.

    ``std`` is about the mean, ``iqr`` about the median, ``mean ci`` and ``median ci`` are bootstrap intervals (1000 resamples;
    below three values there are none).
    """
    if kind == "std":
        out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("centre"), F.stddev_pop(value).alias("s"))
        out = out.select(*keys, "n", "centre", (F.col("centre") - F.col("s")).alias("low"), (F.col("centre") + F.col("s")).alias("high"))
    elif kind == "iqr":
        out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, [0.25, 0.5, 0.75]).alias("p"))
        out = out.select(*keys, "n", F.col("p")[1].alias("centre"), F.col("p")[0].alias("low"), F.col("p")[2].alias("high"))
    elif kind in ("mean ci", "median ci"):
        return resampling.bootstrap(rows, keys, value, resampling.MEAN if kind == "mean ci" else resampling.MEDIAN).select(*keys, "n", "centre", F.col("lo").alias("low"), F.col("hi").alias("high"))
    else:
        raise ValueError(f"no envelope {kind}")
    return out.filter("n > 0").select(*keys, "n", "centre", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("low", "high")])


def with_intervals(stats: DataFrame, rows: DataFrame, keys: list[str], value: str, seed: str = "0", boots: int = 1000) -> DataFrame:
    """``stats``, one row a key, with bootstrap bounds mean_lo, mean_hi, median_lo and median_hi of ``value``; null keys match."""
    for name, statistic in (("mean", resampling.MEAN), ("median", resampling.MEDIAN)):
        found = resampling.bootstrap(rows, keys, value, statistic, seed, boots)
        found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        stats = stats.join(found, same, "left").drop(*[f"_{k}" for k in keys])
    return stats


def summary_intervals(rows: DataFrame, categories: list[str], score: str, seed: str = "0", boots: int = 1000) -> DataFrame:
    """``category_summary`` with bootstrap bounds of mean and median; below three values there are none."""
    return with_intervals(category_summary(rows, categories, score), rows, categories, score, seed, boots)


def compartment_intervals(members: DataFrame, rows: DataFrame, entity: str, x: str, value: str, bins: int, seed: str = "0", boots: int = 1000) -> DataFrame:
    """Per x and bin: mean, deviation, five percentiles, n, support and bootstrap bounds of mean and median.

    ``members`` has (entity, bin); it must have ``bins`` bins that hold two entities or more each, else it is an error.
    """
    found = members.groupBy("bin").agg(F.count_distinct(entity).alias("n")).filter("n > 1").count()
    if found < bins:
        raise ValueError(f"{found} of {bins} compartments have more than one {entity}")
    every = rows.groupBy(x).agg(F.count(value).alias("total"))
    inside = members.join(rows, entity)
    stats = inside.groupBy(x, "bin").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, list(PERCENTILES)).alias("p"), F.count(value).alias("n"))
    stats = stats.join(every, x).select(x, "bin", "mean", "std", *[F.col("p")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(PERCENTILES)], "n", (F.col("n") / F.col("total")).alias("support"))
    return with_intervals(stats, inside, [x, "bin"], value, seed, boots)


def line_summary(rows: DataFrame, x: str, hue: str, value: str, scale: float = 1.0, mirror: bool = False) -> DataFrame:
    """Mean and number of complete rows by x and hue; with ``mirror`` also at -x."""
    rows = rows.dropna(subset=[x, hue, value]).select(F.col(x).alias("x"), F.col(hue).alias("hue"), (F.col(value) * scale).alias("v"))
    out = rows.groupBy("x", "hue").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    return out.union(out.filter("x <> 0").withColumn("x", -F.col("x"))) if mirror else out


def line_bands(rows: DataFrame, x: str, hue: str, value: str, seed: str, boots: int = 1000) -> DataFrame:
    """``line_summary`` with bootstrap bounds of the mean, lo and hi; below three values there are none."""
    rows = rows.dropna(subset=[x, hue, value]).select(F.col(x).alias("x"), F.col(hue).alias("hue"), F.col(value).alias("v"))
    return bootstrap_interval(rows, ["x", "hue"], "v", seed, boots)


def compartment_stats(members: DataFrame, rows: DataFrame, entity: str, x: str, value: str) -> DataFrame:
    """Per x and bin: mean, deviation, quartiles, number and share of all values at that x. ``members`` has (entity, bin)."""
    every = rows.groupBy(x).agg(F.count(value).alias("total"))
    stats = members.join(rows, entity).groupBy(x, "bin").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, [0.25, 0.5, 0.75]).alias("p"), F.count(value).alias("n"))
    return stats.join(every, x).select(x, "bin", "mean", "std", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((25, 50, 75))], "n", (F.col("n") / F.col("total")).alias("support"))


def compartment_shares(members: DataFrame, rows: DataFrame, entity: str, value: str, width: float) -> DataFrame:
    """Share of each compartment's values by stretches of ``width``: (bin, stretch, share)."""
    counts = members.join(rows, entity).groupBy("bin", F.floor(F.col(value) / width).alias("stretch")).agg(F.count("*").alias("n"))
    return counts.select("bin", "stretch", (F.col("n") / F.sum("n").over(Window.partitionBy("bin"))).alias("share"))


def merged_mean(points: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean track of each group of tracks (track, head) over the times that all its tracks have."""
    size = groups.groupBy("head").agg(F.count("*").alias("size"))
    rows = points.join(groups, "track").groupBy("head", "tp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return rows.join(size, "head").filter("n = size").select("head", "tp", "x", "y")


def percentile_limits(rows: DataFrame, group: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Bounds of each group without its extremes; missing values don't count."""
    rows = rows.groupBy(group).agg(F.percentile(value, [low, high]).alias("p"))
    return rows.select(group, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def crops(rows: DataFrame, key: str, seed: str, draws: int, width: int, height: int, smallest: int, largest: int) -> DataFrame:
    """``draws`` parameter sets a row: size, angle, flips and corner, all inside the image and fixed by ``seed``."""
    rows = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = lambda name: uniform(seed, F.col(key), F.col("draw"), name)
    rows = rows.withColumn("size", (smallest + F.floor(u("size") * (largest - smallest + 1))).cast("int"))
    corner = lambda name, span: F.floor(u(name) * (span - F.col("size") + 1)).cast("int")
    return rows.select(key, "draw", "size", (u("angle") * 360).alias("angle"), (u("flip_x") < 0.5).alias("flip_x"), (u("flip_y") < 0.5).alias("flip_y"), corner("x0", width).alias("x0"), corner("y0", height).alias("y0"))


def drawn(rows: DataFrame, key: str, seed: str, draws: int) -> DataFrame:
    """``draws`` draws with replacement over keys 0 .. n-1: (key, times)."""
    n = rows.agg(F.count("*").alias("n"))
    picks = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(F.floor(uniform(seed, F.col("draw")) * F.col("n")).cast("long").alias(key))
    return rows.join(picks.groupBy(key).agg(F.count("*").alias("times")), key).select(key, "times")


def parameters(points: DataFrame) -> DataFrame:
    """Per track: mean radius from the mean of all points, last time, path, displacement, velocity, speed and straightness."""
    centre = points.agg(F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("y"), 6).alias("my"))
    rows = points.join(F.broadcast(centre), how="cross").withColumn("radius", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    rows = rows.withColumn("step", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order()), F.col("y") - F.lag("y").over(order())), F.lit(0.0)))
    end = lambda c: F.max_by(c, "tp") - F.min_by(c, "tp")
    rows = rows.groupBy("track").agg(F.avg("radius").alias("radius"), F.max("t").alias("time"), F.sum("step").alias("distance"), F.hypot(end("x"), end("y")).alias("displacement"), end("t").alias("duration"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return rows.select("track", "radius", "time", "distance", "displacement", ratio("displacement", "duration").alias("velocity"), ratio("distance", "duration").alias("speed"), ratio("displacement", "distance").alias("straightness"))


def welch_by_bin(rows: DataFrame, bin_: str, names: list[str]) -> DataFrame:
    """Welch's statistic and degrees of freedom of each parameter between each two bins, all in one job: (name, bin1, bin2, statistic, df)."""
    long = rows.select(bin_, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("e")).select(F.col(bin_).alias("bin"), "e.name", "e.v")
    own = long.groupBy("name", "bin").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).filter("n > 1")
    a, b = (own.select("name", *[F.col(c).alias(f"{c}{i}") for c in ("bin", "n", "m", "s")]) for i in (1, 2))
    pairs = a.join(b, "name").filter("bin1 < bin2")
    e = [F.col(f"s{i}") / F.col(f"n{i}") for i in (1, 2)]
    df = F.pow(e[0] + e[1], 2) / (F.pow(e[0], 2) / (F.col("n1") - 1) + F.pow(e[1], 2) / (F.col("n2") - 1))
    return pairs.filter(e[0] + e[1] > 0).select("name", "bin1", "bin2", ((F.col("m1") - F.col("m2")) / F.sqrt(e[0] + e[1])).alias("statistic"), df.alias("df"))


def permuted(rows: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """The first ``k`` rows of a permutation of the distinct keys that ``seed`` fixes, with their ``place`` in it; only these are sorted."""
    first = rows.withColumn("_u", uniform(seed, F.col(key))).orderBy("_u", key).limit(k)
    return first.withColumn("place", F.row_number().over(Window.orderBy("_u", key)) - 1).drop("_u")
