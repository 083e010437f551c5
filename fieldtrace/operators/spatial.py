"""Spatial joins over frames of points (tp, pt, x, y): radius, nearest, mutual, merges, gap closing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .written import written


def grid_join(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, half: bool = False) -> DataFrame:
    """All pairs of a shared frame within ``radius``, with ``dist``: columns pt1, x1, y1, pt2, x2, y2.

    Cells have the radius as side, so that partners are in the nine cells around; the equi-join on
    (tp, cell) replaces a cross join, and dense cells can be split by adaptive skew joins. Sizes are estimated before the nine
    cells, so the hint keeps the spread points from being broadcast through the driver. With ``half``, for a set met with itself, only the
    point's own cell and four of those around are searched, and ``ahead`` tells which pairs are of different cells.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if not half or (i, j) >= (0, 0)])
    a = left.select("tp", F.col("pt").alias("pt1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(near).alias("o"))
    a = a.withColumn("cx", cell("x1") + F.col("o.i")).withColumn("cy", cell("y1") + F.col("o.j"))
    a = a.withColumn("ahead", (F.col("o.i") != 0) | (F.col("o.j") != 0)).drop("o") if half else a.drop("o")
    b = right.select("tp", F.col("pt").alias("pt2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    pairs = a.join(b.hint("merge"), ["tp", "cx", "cy"]).withColumn("dist", F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)))
    return pairs.filter(F.col("dist") < radius if strict else F.col("dist") <= radius).drop("cx", "cy")


#: Points of one place that are one row of a search.
CROWD = 512


def _crowds(points: DataFrame) -> DataFrame:
    """(tp, x, y, pt): the points of each place as sorted arrays of at most ``CROWD``."""
    spots = points.groupBy("tp", "x", "y").agg(F.sort_array(F.collect_list("pt")).alias("all"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CROWD).cast("int")), lambda k: F.slice("all", k * CROWD + 1, CROWD))
    return spots.filter(F.size("all") > 0).select("tp", "x", "y", F.explode(parts).alias("pt"))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """``grid_join`` as (tp, pt1, pt2, dist): places are searched, and a pair of places is spread over its pairs of points at the end."""
    pairs = grid_join(_crowds(left), _crowds(right), radius, strict).select("tp", F.explode("pt1").alias("pt1"), "pt2", "dist")
    return pairs.select("tp", "pt1", F.explode("pt2").alias("pt2"), "dist")


def crowd_pairs(points: DataFrame, radius: float, step: int = 1) -> DataFrame:
    """(tp, pt1, pt2, dist): as ``next_frames``, nearer than ``radius``, of arrays of points in one place."""
    return grid_join(_crowds(points), _crowds(earlier(points, step)), radius, strict=True).select("tp", "pt1", "pt2", "dist")


def radius_edges(points: DataFrame, radius: float) -> DataFrame:
    """(tp, a, b): points of a frame within ``radius``, a < b, searched as in ``radius_pairs``, each pair of places from one side."""
    spots = _crowds(points)
    own = [F.struct(f"x{i}", f"y{i}", F.element_at(f"pt{i}", 1)) for i in (1, 2)]
    pairs = grid_join(spots, spots, radius, half=True).filter(F.col("ahead") | (own[0] <= own[1])).withColumn("same", ~F.col("ahead") & (own[0] == own[1]))
    pairs = pairs.select("tp", "same", F.explode("pt1").alias("pt1"), "pt2").select("tp", "same", "pt1", F.explode("pt2").alias("pt2"))
    pairs = pairs.filter(F.when(F.col("same"), F.col("pt1") < F.col("pt2")).otherwise(F.col("pt1") != F.col("pt2")))
    return pairs.select("tp", F.least("pt1", "pt2").alias("a"), F.greatest("pt1", "pt2").alias("b"))


def next_frames(points: DataFrame, radius: float, step: int = 1, strict: bool = False) -> DataFrame:
    """Pairs (tp, pt1, pt2, dist) between each frame and the ``step``-th after it; tp is the earlier one."""
    return radius_pairs(points, earlier(points, step), radius, strict)


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """Each later point picks its nearest earlier one, then each earlier point keeps its closest claimant."""
    claims = pairs.groupBy("tp", "pt2").agg(F.min(F.struct("dist", "pt1")).alias("best")).select("tp", "pt2", F.col("best.pt1").alias("pt1"), F.col("best.dist").alias("dist"))
    return _kept(claims)


def mutual_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that are nearest to each other."""
    best = lambda own, other: pairs.groupBy("tp", own).agg(F.min(F.struct("dist", other)).alias("m")).select("tp", own, F.col(f"m.{other}").alias(other), F.col("m.dist").alias("dist"))
    return best("pt1", "pt2").join(best("pt2", "pt1").drop("dist").hint("merge"), ["tp", "pt1", "pt2"]).select("tp", "pt1", "pt2", "dist")


def places(points: DataFrame) -> DataFrame:
    """The least ``pt`` of each place (tp, x, y): of points in one place no other is ever nearest, as equal distances go by ``pt``."""
    return points.groupBy("tp", "x", "y").agg(F.min("pt").alias("pt"))


def _claims(left: DataFrame, right: DataFrame, radius: float, strict: bool) -> DataFrame:
    """(tp, pt2, x2, y2, pt1, x1, y1, dist): the nearest place of ``left`` for each place of ``right``."""
    return tiles.nearest(places(right), places(left), radius, strict).toDF("tp", "pt2", "x2", "y2", "pt1", "x1", "y1", "dist")


def _kept(claims: DataFrame) -> DataFrame:
    """The closest claimant of each earlier point."""
    best = claims.groupBy("tp", "pt1").agg(F.min(F.struct("dist", "pt2")).alias("best"))
    return best.select("tp", "pt1", F.col("best.pt2").alias("pt2"), F.col("best.dist").alias("dist"))


def nearest_links(left: DataFrame, right: DataFrame, radius: float, strict: bool = True) -> DataFrame:
    """``nearest_pairs`` of all points within ``radius``; the search grows with places, and the pairs within the radius aren't made."""
    return _kept(_claims(left, right, radius, strict))


def mutual_links(left: DataFrame, right: DataFrame, radius: float, strict: bool = True) -> DataFrame:
    """``mutual_pairs`` of all points within ``radius``, searched as in ``nearest_links``."""
    one, two = _claims(right, left, radius, strict), _claims(left, right, radius, strict)
    first = one.select("tp", F.col("pt2").alias("pt1"), F.col("pt1").alias("pt2"), "dist")
    return first.join(two.select("tp", "pt1", "pt2").hint("merge"), ["tp", "pt1", "pt2"]).select("tp", "pt1", "pt2", "dist")


def earlier(points: DataFrame, step: int = 1) -> DataFrame:
    """The points under the frame ``step`` before theirs."""
    return points.withColumn("tp", F.col("tp") - step)


def without_isolated(points: DataFrame, radius: float) -> DataFrame:
    """Points with a neighbour nearer than ``radius`` in both adjacent frames; an empty frame asks for nothing."""
    frames, kept, spots = points.select("tp").distinct(), points, places(points)
    for step in (1, -1):
        near = tiles.nearest(spots, earlier(spots, step), radius, strict=True).select("tp", "x", "y", F.lit(True).alias("met"))
        free = frames.join(frames.select((F.col("tp") - step).alias("tp")), "tp", "left_anti").withColumn("free", F.lit(True))
        kept = kept.join(near.hint("merge"), ["tp", "x", "y"], "left").join(free, "tp", "left").filter("met OR free").select(points.columns)
    return kept


def merged(first: DataFrame, second: DataFrame, radius: float) -> DataFrame:
    """Midpoints of nearest pairs of two point sets (tp, pt, x, y), with the points of either that have no partner: (tp, kind, pt1, pt2, x, y).

    The search runs once; pairs carry both points, and each side's rest is what the pairs don't name.
    """
    claims = _claims(first, second, radius, strict=True).select("tp", "pt2", F.struct("dist", "pt1", "x1", "y1", "x2", "y2").alias("m"))
    best = claims.groupBy("tp", F.col("m.pt1").alias("pt1")).agg(F.min(F.struct(F.col("m.dist").alias("dist"), "pt2", *[F.col(f"m.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])).alias("m"))
    middle = lambda c: ((F.col(f"m.{c}1") + F.col(f"m.{c}2")) / 2).alias(c)
    chosen = written(best.select("tp", "pt1", F.col("m.pt2").alias("pt2"), middle("x"), middle("y")))
    both = chosen.select("tp", F.lit("pair").alias("kind"), "pt1", "pt2", "x", "y")
    one = first.withColumnRenamed("pt", "pt1").join(chosen, ["tp", "pt1"], "left_anti").select("tp", F.lit("first").alias("kind"), "pt1", F.lit(None).cast("int").alias("pt2"), "x", "y")
    two = second.withColumnRenamed("pt", "pt2").join(chosen, ["tp", "pt2"], "left_anti").select("tp", F.lit("second").alias("kind"), F.lit(None).cast("int").alias("pt1"), "pt2", "x", "y")
    return both.unionByName(one).unionByName(two)


def match_counts(truth: DataFrame, test: DataFrame, radius: float) -> DataFrame:
    """Per frame: matched, missed and extra points, precision, recall and agreement."""
    hits = mutual_links(truth, test, radius, strict=False).groupBy("tp").agg(F.count("*").alias("matched"))
    sides = truth.groupBy("tp").agg(F.count("*").alias("n1")).join(test.groupBy("tp").agg(F.count("*").alias("n2")), "tp", "full").join(hits, "tp", "left").na.fill(0)
    rows = sides.select("tp", "matched", (F.col("n1") - F.col("matched")).alias("missed"), (F.col("n2") - F.col("matched")).alias("extra"), "n1", "n2")
    ratio = lambda n: F.when(n > 0, F.col("matched") / n)
    return rows.select("tp", "matched", "missed", "extra", ratio(F.col("n2")).alias("precision"), ratio(F.col("n1")).alias("recall"), ratio(F.col("matched") + F.col("missed") + F.col("extra")).alias("agreement"))


def gap_candidates(tracks: DataFrame, max_lag: float, max_dist: float, place: str = "track") -> DataFrame:
    """For each start of a track the best earlier end: 0 < lag <= max_lag and dist <= max_dist, least (lag, dist, place): (track, before, lag, dist).

    ``tracks`` has track, t0, x0, y0 (start) and t1, x1, y1 (end). Tiles of place and lag are searched. Starts of one time and place have one
    best end, and of ends of one time and place only the first by ``place`` is ever best, so that the search grows with places; a track
    that ends before it starts could meet itself and is alone in either.
    """
    rows = tracks.withColumn("own", F.when(F.col("t1") < F.col("t0"), F.col("track")))
    ends = rows.groupBy("t1", "x1", "y1", "own").agg(F.min(F.struct(F.col(place).alias("rank"), F.col("track").alias("a"))).alias("e"))
    ends = ends.select(F.col("e.a").alias("track"), "e.rank", F.col("t1").alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    starts = rows.select("own", F.col("t0").alias("t"), F.col("x0").alias("x"), F.col("y0").alias("y")).distinct()
    best = tiles.latest(starts, ends, max_lag, max_dist).toDF("_own", "_t0", "_x0", "_y0", "before", "lag", "dist").hint("merge")
    same = (F.col("t0") == F.col("_t0")) & (F.col("x0") == F.col("_x0")) & (F.col("y0") == F.col("_y0")) & F.col("own").eqNullSafe(F.col("_own"))
    return rows.join(best, same).select("track", "before", "lag", "dist")


def clustered(points: DataFrame, radius: float) -> DataFrame:
    """Points (tp, pt, x, y) merged in balls: each point goes to the first point, by ``pt``, within ``radius``, itself included; (tp, head, x, y, n) are means. Points of one place have one head, so the search grows with places."""
    spots = points.groupBy("tp", "x", "y").agg(F.min("pt").alias("pt"), F.count("*").alias("n"))
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return tiles.heads(spots, radius).groupBy("tp", "head").agg(mean("x"), mean("y"), F.sum("n").alias("n"))
