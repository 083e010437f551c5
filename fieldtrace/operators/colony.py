"""Parameters of tracks inside a colony, and their differences between rings around its centre."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import groups, mesh, persistence, tracks

#: Parameters of a track, in the order of ``parameters``; the radius says which ring it is in.
NAMES = ("distance", "displacement", "velocity", "speed", "persistence", "disp_to_dist", "density", "area", "divergence", "curl")


def fields(points: DataFrame, near: DataFrame | float, links: DataFrame, radii: DataFrame, chain: DataFrame | None = None, time_scale: float = 1.0, local: DataFrame | None = None) -> DataFrame:
    """Per track and time: (track, tp, pt, t, radius, distance, displacement, persistence, density, area, divergence, curl).

    ``points`` has (track, tp, pt, x, y), ``near`` neighbouring points (tp, a, b) of a frame or a radius, ``links`` (tp, pt1, pt2), ``radii`` the
    distance from the centre in units of the rim (tp, pt, radius), and ``chain`` the tracks' ``persistence.timeline`` over tp. Area is that of
    the polygon of a point's neighbours, density one over it; divergence is the change of area and curl the turn of the neighbours
    along links; persistence is the share of persistent times from tp on and before the next. What a point lacks is null. Where ``local`` has
    the areas and densities (tp, pt, area, density) only the links' points need neighbours. Joins are hinted, so that no table of points goes through the driver.
    """
    places = points.select("tp", "pt", "x", "y")
    if local is None and not isinstance(near, DataFrame):
        local = mesh.radius_density(places, near)
    elif local is None:
        around = mesh.both_ways(near).join(places.withColumnRenamed("pt", "near").hint("merge"), ["tp", "near"])
        local = mesh.local_density(around.select("tp", "pt", "x", "y"))
    found = [
        radii.select("tp", "pt", "radius"),
        local,
        mesh.divergence(local, links, "area", time_scale).withColumnRenamed("rate", "divergence"),
        mesh.rotation(places, near, links).withColumnRenamed("turn", "curl"),
    ]
    rows = points.select("track", "tp", "pt", (F.col("tp") * time_scale).alias("t")).join(tracks.motion(points).select("track", "tp", "distance", "displacement").hint("merge"), ["track", "tp"])
    rows = reduce(lambda a, b: a.join(b.hint("merge"), ["tp", "pt"], "left"), found, rows)
    if chain is None:
        return rows.withColumn("persistence", F.lit(None).cast("double"))
    share = persistence.waveform(chain).groupBy("track", F.floor("t").cast("int").alias("tp")).agg(F.avg(F.col("persistent").cast("double")).alias("persistence"))
    return rows.join(share.hint("merge"), ["track", "tp"], "left")


def parameters(rows: DataFrame) -> DataFrame:
    """(track, radius, NAMES): means over a track's times, of path and displacement the greatest; velocity and speed are these by the track's last time."""
    out = rows.groupBy("track").agg(*[F.avg(c).alias(c) for c in ("radius", "persistence", "density", "area", "divergence", "curl")], *[F.max(c).alias(c) for c in ("distance", "displacement", "t")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.withColumns({"velocity": ratio("displacement", "t"), "speed": ratio("distance", "t"), "disp_to_dist": ratio("displacement", "distance")})
    return out.select("track", "radius", *NAMES)


def ring_tests(rows: DataFrame, names: tuple[str, ...] = NAMES, bins: int = 3, equal_area: bool = True) -> DataFrame:
    """(name, bin1, bin2, n1, n2, statistic, df): Student's statistic of each parameter between each two rings of equal area, all in one job."""
    rings = groups.radial_bins(rows, "radius", bins, equal_area, decimals=2)
    long = rings.select("bin", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("e")).select("bin", "e.name", "e.v")
    own = long.groupBy("name", "bin").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).filter("n > 1")
    a, b = (own.select("name", *[F.col(c).alias(f"{c}{i}") for c in ("bin", "n", "m", "s")]) for i in (1, 2))
    pairs = a.join(b, "name").filter("bin1 < bin2")
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("s1") + (F.col("n2") - 1) * F.col("s2")) / df
    statistic = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    return pairs.filter(pooled > 0).select("name", "bin1", "bin2", "n1", "n2", statistic.alias("statistic"), df.cast("double").alias("df"))


def radial_significance(rows: DataFrame, names: tuple[str, ...] = NAMES, bins: int = 3, equal_area: bool = True, alpha: float | None = None) -> DataFrame:
    """``ring_tests`` with two-sided p-values and their Holm correction over each parameter's pairs; with ``alpha`` only those at or under it."""
    out = ring_tests(rows, names, bins, equal_area).withColumn("p", groups.student_p_column("statistic", "df"))
    own = Window.partitionBy("name").orderBy("p", "bin1", "bin2")
    raw = (F.count("*").over(Window.partitionBy("name")) - F.row_number().over(own) + 1) * F.col("p")
    out = out.withColumn("raw", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("raw").over(own.rowsBetween(Window.unboundedPreceding, 0)))).drop("raw")
    return out if alpha is None else out.filter(F.col("adjusted") <= alpha)
