"""Neighbour meshes of frames of points (tp, pt, x, y), and what rests on their edges, triangles and links."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import geometry

from . import tiles
from .written import written

TRIANGLES = "tp int, a long, b long, c long, xa double, ya double, xb double, yb double, xc double, yc double"


def _circle(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Centre x, centre y and squared radius of the circle through each three points."""
    a, b, c = p[corners[:, 0]], p[corners[:, 1]] - p[corners[:, 0]], p[corners[:, 2]] - p[corners[:, 0]]
    d, bb, cc = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]), (b * b).sum(1), (c * c).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb], 1) / d[:, None]
    flat = ~np.isfinite(u).all(1)
    return np.column_stack([np.where(flat[:, None], 0, u + a), np.where(flat, np.inf, (u * u).sum(1))])


def triangulate(xy: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
    """Delaunay triangles by insertion, as sorted rows of indices; none for points on one line.

    Points are moved by less than 1e-7 of their extent, by their index, so that points on one circle have one answer, unless
    ``moved`` has moved places in units of an extent.
    """
    if len(xy) < 3 or np.linalg.matrix_rank(xy - xy[0], tol=1e-9) < 2:
        return np.empty((0, 3), int)
    n, span = len(xy), float(np.ptp(xy, axis=0).max())
    k = np.arange(1, n + 1)
    p = moved - moved.mean(0) if moved is not None else (xy - xy.mean(0)) / span + 1e-7 * np.stack([np.modf(k * 0.6180339887)[0], np.modf(k * 0.7548776662)[0]], 1)
    p = np.vstack([p, [[-1e3, -1e3], [1e3, -1e3], [0, 1e3]]])
    corners, circles, ended = np.array([[n, n + 1, n + 2]]), np.zeros((0, 3)), []
    circles, ahead = _circle(p, corners), 64
    for i in np.argsort(p[:n, 0], kind="stable"):
        if len(corners) > ahead:  # circles that end before this point hold no later one
            past = circles[:, 0] + np.sqrt(circles[:, 2]) < p[i, 0]
            ended.append(corners[past])
            corners, circles = corners[~past], circles[~past]
            ahead = 64 + 2 * len(corners)
        away = circles[:, :2] - p[i]
        inside = away[:, 0] * away[:, 0] + away[:, 1] * away[:, 1] < circles[:, 2]
        hit = np.flatnonzero(inside)
        sides = np.sort(corners[hit][:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), 1)
        key = np.sort(sides[:, 0] * (n + 3) + sides[:, 1])
        alone = np.ones(len(key) + 1, bool)
        alone[1:-1] = key[1:] != key[:-1]
        rim = key[alone[:-1] & alone[1:]]
        new = np.column_stack([rim // (n + 3), rim % (n + 3), np.full(len(rim), i)])
        round_ = _circle(p, new)
        k = min(len(hit), len(new))
        corners[hit[:k]], circles[hit[:k]] = new[:k], round_[:k]
        if len(hit) > k:
            circles[hit[k:], 2] = -1.0
            kept = circles[:, 2] >= 0
            corners, circles = corners[kept], circles[kept]
        elif len(new) > k:
            corners, circles = np.concatenate([corners, new[k:]]), np.concatenate([circles, round_[k:]])
    corners = np.concatenate([*ended, corners])
    return np.sort(corners[(corners < n).all(1)], 1)


#: Points of a tile of a frame, about. Margin of halos and circles in units of the frame's extent, how far points are moved, and the
#: halo of a small tile by its side.
TILE, MARGIN, SHIFT, HALO = 1000, 1e-6, 1e-7, 0.125
_NAMES = [part.split()[0] for part in TRIANGLES.split(", ")]
_FOUND = TRIANGLES + ", kind int, pt long"
_CANDIDATE = TRIANGLES + ", cx double, cy double, r2 double"


def _moved(points: DataFrame) -> DataFrame:
    """Points of distinct places with moved places (u, v) in units of their frame's extent, and that extent: (tp, pt, x, y, u, v, span).

    Of coincident points the least ``pt`` stands for all. Points are moved by their number, so that points on one circle have one answer in every tile.
    """
    rows = points.filter("x is not null and y is not null").groupBy("tp", "x", "y").agg(F.min("pt").alias("pt"))
    ends = rows.groupBy("tp").agg(F.min("x").alias("lo_x"), F.min("y").alias("lo_y"), F.greatest(*[F.max(c) - F.min(c) for c in "xy"]).alias("span")).filter("span > 0")
    unit = lambda k: F.pmod(F.xxhash64("pt", F.lit(k)), F.lit(1 << 52)) / (1 << 52)
    place = lambda c, k: (F.col(c) - F.col(f"lo_{c}")) / F.col("span") + SHIFT * unit(k)
    return rows.join(ends, "tp").select("tp", "pt", "x", "y", place("x", 1).alias("u"), place("y", 2).alias("v"), "span")


def _tiles(rows: DataFrame, least: Column) -> DataFrame:
    """``rows`` of ``_moved`` with their tile (i, j), of about ``TILE`` points but no narrower than ``least``, the tiles' side and their last numbers."""
    wide, high = F.max("u"), F.max("v")
    side = F.least(F.lit(1.0), F.greatest(F.sqrt(wide * high * TILE / F.count("*")), F.first(least)))
    ends = rows.groupBy("tp").agg(side.alias("side"), wide.alias("wide"), high.alias("high"))
    ends = ends.select("tp", "side", *[F.greatest(F.ceil(F.col(w) / F.col("side")) - 1, F.lit(0)).cast("int").alias(f"last_{k}") for k, w in (("i", "wide"), ("j", "high"))])
    own = lambda c, k: F.greatest(F.least(F.floor(F.col(c) / F.col("side")), F.col(f"last_{k}")), F.lit(0)).cast("int").alias(k)
    return rows.join(ends, "tp").select("*", own("u", "i"), own("v", "j"))


def _spread(rows: DataFrame, reach: Column) -> DataFrame:
    """``rows`` of ``_tiles`` once for each tile (ti, tj) that they are in or within ``reach`` of."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = rows.withColumn("o", around).withColumn("ti", F.col("i") + F.col("o.a")).withColumn("tj", F.col("j") + F.col("o.b"))
    near = lambda c, k: (F.col(c) >= F.col(k) * F.col("side") - reach) & (F.col(c) <= (F.col(k) + 1) * F.col("side") + reach)
    inside = lambda k: (F.col(f"t{k}") >= 0) & (F.col(f"t{k}") <= F.col(f"last_{k}"))
    # A stated number of partitions is not coalesced: rows are few here, but each tile is much work.
    return spread.filter(inside("i") & inside("j") & near("u", "ti") & near("v", "tj")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tp", "ti", "tj")


def _triangles(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]:
    """Triangles of the points of a tile, in order of ``pt``: places, circles, squared longest sides, whether a point is in the tile's core, and columns."""
    xy, uv, pt = own[["x", "y"]].to_numpy(float), own[["u", "v"]].to_numpy(float), own["pt"].to_numpy()
    t = triangulate(xy, uv)
    longest = np.stack([((xy[t[:, a]] - xy[t[:, b]]) ** 2).sum(1) for a, b in ((0, 1), (1, 2), (0, 2))]).max(0)
    core = (own["i"].to_numpy() == own["ti"].iloc[0]) & (own["j"].to_numpy() == own["tj"].iloc[0])
    columns = {"tp": np.full(len(t), own["tp"].iloc[0])} | {c: pt[t[:, k]] for k, c in enumerate("abc")}
    columns |= {f"{d}{c}": xy[t[:, k], j] for k, c in enumerate("abc") for j, d in enumerate("xy")}
    return t, _circle(uv, t) if len(t) else np.zeros((0, 3)), longest, core, columns


def delaunay(points: DataFrame, max_distance: float) -> DataFrame:
    """Triangles (tp, a, b, c and their coordinates) of each frame whose three sides are at most ``max_distance`` long.

    A frame is cut to small tiles of about ``TILE`` points, each triangulated with the points of a narrow halo. A triangle is sure if the part
    of its circle inside the frame lies in the tile and its halo, and a point is settled if sure triangles close around it. Other triangles have
    three unsettled points, few and near the frame's rim or in its sparse parts: these points and those around them are triangulated in tiles no narrower than
    ``max_distance``, with halos of that width, and the circles are held against all points. Of coincident points the least
    ``pt`` stands for all; rows with a null coordinate have no part.
    """
    rows = written(_tiles(_moved(points), F.lit(0.0)))

    def small(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pt")
        t, circle, longest, core, columns = _triangles(own)
        side, ti, tj = (own[c].iloc[0] for c in ("side", "ti", "tj"))
        r = np.sqrt(circle[:, 2]) * (1 + MARGIN) + MARGIN
        sure, halo = np.ones(len(t), bool), side * HALO - MARGIN
        for k, at, last in ((0, ti, own["last_i"].iloc[0]), (1, tj, own["last_j"].iloc[0])):
            sure &= (circle[:, k] - r >= at * side - halo) if at > 0 else True
            sure &= (circle[:, k] + r <= (at + 1) * side + halo) if at < last else True
        n = len(own)
        # The sure triangles close around a point if each of its sides has two.
        sides = np.sort(t[sure][:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), 1)
        pairs, times = np.unique(sides[:, 0] * n + sides[:, 1], return_counts=True)
        open_ = np.bincount(np.concatenate([pairs // n, pairs % n]).astype(np.int64), np.tile(times != 2, 2), n) > 0
        settled = ~open_ & (np.bincount(t[sure].ravel(), minlength=n) > 0)
        loose = core & ~settled
        around = np.zeros(n, bool)
        around[t[loose[t].any(1)].ravel()] = True
        around &= ~loose
        mine = core[t].sum(1)
        kept = sure & (mine > 0) & (longest <= max_distance**2) & ~loose[t].all(1)
        out = pd.DataFrame(columns)[kept]
        out["kind"], out["pt"] = np.where(mine[kept] == 3, 0, 1), -1
        flat = np.flatnonzero(loose | around)
        rest = pd.DataFrame({c: np.zeros(len(flat), out[c].dtype) for c in _NAMES} | {"kind": np.where(loose[flat], 2, 3), "pt": own["pt"].to_numpy()[flat]})
        rest["tp"] = own["tp"].iloc[0]
        return pd.concat([out, rest])

    def large(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pt")
        t, circle, longest, core, columns = _triangles(own)
        kept = (longest <= max_distance**2) & core[t[:, 0]] & (own["kind"].to_numpy()[t] == 2).all(1)
        return pd.DataFrame(columns | {"cx": circle[:, 0], "cy": circle[:, 1], "r2": circle[:, 2]})[kept]

    found = written(_spread(rows, F.col("side") * HALO).groupBy("tp", "ti", "tj").applyInPandas(small, _FOUND))
    rest = found.filter("kind >= 2").groupBy("tp", "pt").agg(F.min("kind").alias("kind"))
    rest = rows.select("tp", "pt", "x", "y", "u", "v", "span").join(rest.hint("merge"), ["tp", "pt"])
    reach = max_distance / F.col("span") + MARGIN
    spread = _spread(written(_tiles(rest, max_distance / F.col("span") + 2 * MARGIN)), reach)
    asked = written(spread.groupBy("tp", "ti", "tj").applyInPandas(large, _CANDIDATE))
    sizes = rows.groupBy("tp").agg(*[F.first(c).alias(c) for c in ("side", "last_i", "last_j")])
    r = F.sqrt("r2")
    span = lambda c, k: F.sequence(*[F.greatest(F.least(F.floor((F.col(c) + sign * r) / F.col("side")), F.col(f"last_{k}")), F.lit(0)).cast("int") for sign in (-1, 1)])
    met = asked.join(sizes, "tp").select("tp", "a", "b", "c", "cx", "cy", "r2", "side", F.explode(span("cx", "i")).alias("i"), span("cy", "j").alias("js")).select("*", F.explode("js").alias("j"))
    off = lambda c, k: F.greatest(F.col(k) * F.col("side") - F.col(c), F.col(c) - (F.col(k) + 1) * F.col("side") - SHIFT, F.lit(0.0))
    met = met.filter(F.pow(off("cx", "i"), 2) + F.pow(off("cy", "j"), 2) <= F.col("r2") * (1 + 1e-9)).drop("side")
    held = met.join(rows.select("tp", "i", "j", "pt", "u", "v").hint("merge"), ["tp", "i", "j"])
    full = (F.pow(F.col("u") - F.col("cx"), 2) + F.pow(F.col("v") - F.col("cy"), 2) < F.col("r2")) & ~F.col("pt").isin(F.col("a"), F.col("b"), F.col("c"))
    late = asked.join(held.filter(full).select("tp", "a", "b", "c").distinct(), ["tp", "a", "b", "c"], "left_anti").select(_NAMES)
    return found.filter("kind = 0").select(_NAMES).unionByName(found.filter("kind = 1").select(_NAMES).unionByName(late).distinct())


def _sides(triangles: DataFrame) -> DataFrame:
    side = lambda u, v: F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    return triangles.select("tp", F.explode(F.array(side("a", "b"), side("b", "c"), side("a", "c"))).alias("s")).groupBy("tp", "s.a", "s.b").agg(F.count("*").alias("n"))


def edges(triangles: DataFrame) -> DataFrame:
    """Each side once, as (tp, a, b) with a < b."""
    return _sides(triangles).select("tp", "a", "b")


def boundary(triangles: DataFrame) -> DataFrame:
    """Sides of exactly one triangle."""
    return _sides(triangles).filter("n = 1").select("tp", "a", "b")


def triangle_area() -> Column:
    x = {c: F.col(f"x{c}") for c in "abc"}
    return F.abs((x["b"] - x["a"]) * (F.col("yc") - F.col("ya")) - (x["c"] - x["a"]) * (F.col("yb") - F.col("ya"))) / 2


def mean_area(triangles: DataFrame) -> DataFrame:
    """Mean area of the triangles at each point and the density 1 / area; points without triangles have no row."""
    rows = triangles.select("tp", F.explode(F.array("a", "b", "c")).alias("pt"), triangle_area().alias("area")).groupBy("tp", "pt").agg(F.avg("area").alias("area"))
    return rows.withColumn("density", F.when(F.col("area") > 0, 1 / F.col("area")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(tp, pt, near) for both directions of each edge."""
    return edges.select("tp", F.explode(F.array(F.struct(F.col("a").alias("pt"), F.col("b").alias("near")), F.struct(F.col("b").alias("pt"), F.col("a").alias("near")))).alias("e")).select("tp", "e.pt", "e.near")


def neighbours(points: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(tp, pt, near): points exactly ``hops`` edges away; below one hop, the point itself."""
    seen = front = points.select("tp", "pt", F.col("pt").alias("near"))
    ways = both_ways(edges).select("tp", F.col("pt").alias("near"), F.col("near").alias("next"))
    for _ in range(hops):
        front = front.join(ways, ["tp", "near"]).select("tp", "pt", F.col("next").alias("near")).distinct().join(seen, ["tp", "pt", "near"], "left_anti")
        seen = seen.unionByName(front)
    return front


def _two_hops(own: pa.Table, radius: float) -> pa.Table:
    """Pairs of a point of the tile and one that only a third joins to it; places are met once and spread over their points at the end."""
    x, y, pt = (own.column(c).to_numpy() for c in ("x", "y", "pt"))
    core = (own.column("i").to_numpy() == own.column("ti").to_numpy()) & (own.column("j").to_numpy() == own.column("tj").to_numpy())
    place, which = np.unique(np.stack([x, y], 1), axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    first = np.searchsorted(which[order], np.arange(len(place) + 1))
    copies, found = np.diff(first), []
    small = np.floor(place / (radius / 2)).astype(np.int64)
    mine = np.zeros(len(place), bool)
    mine[which[core]] = True
    for cell in np.unique(small[mine], axis=0):
        here = np.flatnonzero(mine & (small == cell).all(1))
        low, high = place[here].min(0), place[here].max(0)
        near = lambda k: np.flatnonzero(((place >= low - k * radius) & (place <= high + k * radius)).all(1))  # noqa: E731, B023
        met = lambda a, b: np.sqrt((place[a, None, 0] - place[None, b, 0]) ** 2 + (place[a, None, 1] - place[None, b, 1]) ** 2) <= radius
        middle, far = near(1.001), near(2.001)
        reached = met(here, middle).astype(np.float32) @ met(middle, far).astype(np.float32) > 0
        a, b = np.nonzero(reached & ~met(here, far))
        a, b = here[a], far[b]
        times = copies[a] * copies[b]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        wide = np.repeat(copies[b], times)
        found.append((order[np.repeat(first[a], times) + at // wide], order[np.repeat(first[b], times) + at % wide]))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return pa.table({"tp": own.column("tp").take(pa.array(np.zeros(len(a), np.int64))), "pt": pt[a], "near": pt[b]})


def two_hops(points: DataFrame, radius: float) -> DataFrame:
    """(tp, pt, near): ``neighbours`` of two hops in the graph of all points of a frame within ``radius``, whose edges aren't made.

    Partners are within twice the radius, the side of the tiles that meet with those around them; only tiles with points of their own have rows.
    """
    side = 2 * radius
    rows = points.select("tp", F.col("pt").cast("long").alias("pt"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["tp", "x", "y"])
    rows = rows.withColumns({"i": F.floor(F.col("x") / side), "j": F.floor(F.col("y") / side)})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = rows.withColumn("o", around).select("tp", "pt", "x", "y", "i", "j", (F.col("i") + F.col("o.a")).alias("ti"), (F.col("j") + F.col("o.b")).alias("tj"))
    spread = spread.repartition(8 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tp", "ti", "tj")
    kind = rows.schema["tp"].dataType.simpleString()
    return spread.groupBy("tp", "ti", "tj").applyInArrow(lambda own: _two_hops(own, radius), f"tp {kind}, pt long, near long")


def central(forward: DataFrame, backward: DataFrame, value: str) -> DataFrame:
    """Mean of forward values and negated backward ones per (tp, pt); a side that is missing or null does not count."""
    return forward.select("tp", "pt", value).unionByName(backward.select("tp", "pt", (-F.col(value)).alias(value))).groupBy("tp", "pt").agg(F.avg(value).alias(value))


def divergence(fields: DataFrame, links: DataFrame, value: str, time_scale: float) -> DataFrame:
    """Rate of change of ``value`` of (tp, pt, value) along links (tp, pt1, pt2) to the next frame, forward and backward combined."""
    early = fields.select("tp", F.col("pt").alias("pt1"), F.col(value).alias("v1")).hint("merge")
    late = fields.select((F.col("tp") - 1).alias("tp"), F.col("pt").alias("pt2"), F.col(value).alias("v2")).hint("merge")
    rate = links.select("tp", "pt1", "pt2").join(early, ["tp", "pt1"]).join(late, ["tp", "pt2"]).withColumn("rate", (F.col("v2") - F.col("v1")) / time_scale)
    return central(rate.select("tp", F.col("pt1").alias("pt"), "rate"), rate.select((F.col("tp") + 1).alias("tp"), F.col("pt2").alias("pt"), (-F.col("rate")).alias("rate")), "rate")


def rotation(points: DataFrame, edges: DataFrame | float, links: DataFrame) -> DataFrame:
    """Mean change of the angle to linked neighbours from a frame to the next, without wrap-around, forward and backward combined.

    A radius instead of edges stands for all points within it, whose edges aren't made.
    """
    at = lambda name: points.select("tp", F.col("pt").alias(f"pt{name}"), F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}")).hint("merge")
    moved = links.select("tp", "pt1", "pt2").join(at(1), ["tp", "pt1"]).join(at(2).withColumn("tp", F.col("tp") - 1), ["tp", "pt2"])
    if isinstance(edges, DataFrame):
        other = moved.select("tp", F.col("pt1").alias("near"), *[F.col(c).alias(f"n{c}") for c in ("x1", "y1", "x2", "y2")])
        pairs = both_ways(edges).withColumnRenamed("pt", "pt1").join(moved.hint("merge"), ["tp", "pt1"]).join(other.hint("merge"), ["tp", "near"])
        turn = F.atan2(F.col("ny2") - F.col("y2"), F.col("nx2") - F.col("x2")) - F.atan2(F.col("ny1") - F.col("y1"), F.col("nx1") - F.col("x1"))
        own = pairs.groupBy("tp", "pt1", "pt2").agg(F.avg(turn).alias("turn"))
    else:
        rows = moved.select("tp", "pt1", "pt2", F.col("x1").alias("x"), F.col("y1").alias("y"), "x2", "y2")
        own = tiles.means(rows, rows.drop("pt2"), edges, _turn, ("turn",), but="pt1")
    return central(own.select("tp", F.col("pt1").alias("pt"), "turn"), own.select((F.col("tp") + 1).alias("tp"), F.col("pt2").alias("pt"), (-F.col("turn")).alias("turn")), "turn")


def _turn(own: dict, near: dict, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray]:
    angle = lambda x, y: np.arctan2(near[y][p] - own[y][q], near[x][p] - own[x][q])
    return (angle("x2", "y2") - angle("x", "y"),)


def moved_by(lone: DataFrame, steps: DataFrame, radius: float, least: int) -> DataFrame:
    """``lone`` (tp, pt, x, y) with the mean step (dx, dy) of the ``steps`` (tp, x, y, dx, dy) that begin within ``radius``, and their number n, ``least`` at least."""
    return tiles.means(lone, steps, radius, lambda _, near, q, p: (near["dx"][p], near["dy"][p]), ("dx", "dy"), least=least)


def imputed(points: DataFrame, edges: DataFrame | float, links: DataFrame, least: int = 3) -> DataFrame:
    """Points of a frame without a link whose ``least`` or more mesh neighbours have one, moved by their mean step: (tp, pt, x, y, n), tp and pt of the point that lacks a partner."""
    at = lambda name: points.select("tp", F.col("pt").alias(f"pt{name}"), F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}")).hint("merge")
    moved = links.select("tp", "pt1", "pt2").join(at(1), ["tp", "pt1"]).join(at(2).withColumn("tp", F.col("tp") - 1), ["tp", "pt2"])
    steps = moved.select("tp", F.col("pt1").alias("near"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    lone = points.select("tp", "pt", "x", "y").join(links.select("tp", F.col("pt1").alias("pt")), ["tp", "pt"], "left_anti")
    if isinstance(edges, DataFrame):
        mean = both_ways(edges).join(steps, ["tp", "near"]).groupBy("tp", "pt").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count("*").alias("n")).filter(F.col("n") >= least)
        own = lone.join(mean.hint("merge"), ["tp", "pt"])
    else:
        own = moved_by(lone, steps.drop("near"), edges, least)
    return own.select("tp", "pt", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "n")


def circumradius() -> Column:
    """Radius of a triangle's circle; null where its corners are on one line."""
    side = lambda u, v: F.hypot(F.col(f"x{u}") - F.col(f"x{v}"), F.col(f"y{u}") - F.col(f"y{v}"))
    return F.when(triangle_area() > 0, side("a", "b") * side("b", "c") * side("a", "c") / (4 * triangle_area()))


def alpha_shape(triangles: DataFrame, alpha: float) -> DataFrame:
    """Outline (tp, a, b) of the triangles whose circle is smaller than ``alpha``: the sides that an odd number of these share."""
    return _sides(triangles.filter(circumradius() < alpha)).filter("n % 2 = 1").select("tp", "a", "b")


def loops(outline: DataFrame) -> DataFrame:
    """(tp, loop, place, pt): closed walks over the outline (tp, a, b) of each frame, from its least point on; dead ends are left out.

    Only outline edges of one frame meet in a task. Where loops touch in a point, a walk leaves on the first free edge by number.
    """

    def frame(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found = []
        for start in sorted(near):
            while near[start]:
                walk = [start]
                while near[walk[-1]]:
                    step = min(near[walk[-1]])
                    near[walk[-1]].discard(step)
                    near[step].discard(walk[-1])
                    if step in walk:
                        cut = walk.index(step)
                        if len(walk) - cut >= 3:
                            found.append(walk[cut:])
                        walk = walk[: cut + 1]
                    else:
                        walk.append(step)
        out = [(rows["tp"].iloc[0], i, k, pt) for i, walk in enumerate(found) for k, pt in enumerate(walk)]
        return pd.DataFrame(out, columns=["tp", "loop", "place", "pt"])

    return outline.groupBy("tp").applyInPandas(frame, "tp int, loop int, place int, pt long")


def longest_loop(walks: DataFrame) -> DataFrame:
    """Per frame the loop of most points, the first of equals."""
    size = walks.groupBy("tp", "loop").agg(F.count("*").alias("n")).groupBy("tp").agg(F.max_by("loop", F.struct("n", -F.col("loop"))).alias("loop"))
    return walks.join(size, ["tp", "loop"], "left_semi")


def sector_rim(points: DataFrame, sectors: int) -> DataFrame:
    """The farthest point from the frame's mean in each of ``sectors`` even sectors around it: (tp, pt, x, y)."""
    mean = points.groupBy("tp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    rows = points.join(mean, "tp").withColumn("dx", F.col("x") - F.col("mx")).withColumn("dy", F.col("y") - F.col("my"))
    sector = F.floor((F.atan2("dy", "dx") + F.pi()) / (2 * F.pi()) * sectors)
    best = rows.groupBy("tp", sector.alias("sector")).agg(F.max_by(F.struct("pt", "x", "y"), F.struct(F.round(F.pow("dx", 2) + F.pow("dy", 2), 6), -F.col("pt"))).alias("p"))
    return best.select("tp", "p.pt", "p.x", "p.y")


def warped(points: DataFrame, rim: DataFrame, steps: int, most: float | None = None, inverse: bool = False) -> DataFrame:
    """Points (tp, pt, x, y) with their distance from the rim's centroid divided by the rim's distance at their angle.

    The rim (tp, x, y) is interpolated at ``steps`` even angles, and between these for each point. Beyond ``most`` rims both
    coordinates are null. ``inverse`` takes points of the unit circle back to the frame.
    """
    order = Window.partitionBy("tp").orderBy("theta")
    vertex = geometry.by_angle(F.collect_list(F.struct("x", "y")))
    centre = rim.groupBy("tp").agg(geometry.centroid(vertex).alias("c")).select("tp", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    polar = rim.join(centre, "tp").select("tp", F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")).alias("theta"), F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")).alias("radius"))
    own, step = Window.partitionBy("tp"), 2 * math.pi / steps
    ring = polar.select("*", F.coalesce(F.lead("theta").over(order), F.min("theta").over(own) + 2 * math.pi).alias("theta1"), F.coalesce(F.lead("radius").over(order), F.min_by("radius", "theta").over(own)).alias("radius1"))
    first, last = F.ceil(F.col("theta") / step), F.ceil(F.col("theta1") / step) - 1
    grid = ring.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    part = (F.col("k") * step - F.col("theta")) / (F.col("theta1") - F.col("theta"))
    grid = grid.select("tp", F.pmod("k", F.lit(steps)).alias("k"), (F.col("radius") + (F.col("radius1") - F.col("radius")) * part).alias("edge"))
    shift = (F.lit(0.0), F.lit(0.0)) if inverse else (F.col("cx"), F.col("cy"))
    rows = points.join(centre, "tp").withColumn("dx", F.col("x") - shift[0]).withColumn("dy", F.col("y") - shift[1]).withColumn("place", F.atan2("dy", "dx") / step)
    rows = rows.withColumn("low", F.floor("place")).withColumn("k0", F.pmod("low", F.lit(steps))).withColumn("k1", F.pmod(F.col("low") + 1, F.lit(steps)))
    for i in (0, 1):
        rows = rows.join(grid.select("tp", F.col("k").alias(f"k{i}"), F.col("edge").alias(f"edge{i}")), ["tp", f"k{i}"])
    edge = F.col("edge0") + (F.col("edge1") - F.col("edge0")) * (F.col("place") - F.col("low"))
    if inverse:
        return rows.select("tp", "pt", (F.col("cx") + F.col("dx") * edge).alias("x"), (F.col("cy") + F.col("dy") * edge).alias("y"))
    inside = F.lit(True) if most is None else F.hypot("dx", "dy") / edge <= most
    return rows.select("tp", "pt", *[F.when(inside, F.col(f"d{c}") / edge).alias(c) for c in "xy"])


def local_density(near: DataFrame) -> DataFrame:
    """One over the area (1 at least) of the polygon that a point's neighbours (tp, pt, x, y of the neighbour) make in order of their angle: (tp, pt, area, density).

    Points of fewer than three neighbours have no row.
    """
    own = near.groupBy("tp", "pt").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("v")).filter(F.size("v") >= 3)
    return own.select("tp", "pt", geometry.area(geometry.by_angle(F.col("v"))).alias("area")).withColumn("density", 1 / F.greatest("area", F.lit(1.0)))


def radius_density(points: DataFrame, radius: float) -> DataFrame:
    """``local_density`` of the points of a frame within ``radius`` of each, itself left out: (tp, pt, area, density).

    Points of one place have the same neighbours, so a polygon is made once a place; points that share a place weigh in the mean
    but add no area, so each place is one vertex.
    """
    spots = points.groupBy("tp", "x", "y").agg(F.count("*").alias("n"))
    areas = tiles.polygon_areas(spots, radius)
    return points.select("tp", "pt", "x", "y").join(areas.hint("merge"), ["tp", "x", "y"]).select("tp", "pt", "area").withColumn("density", 1 / F.greatest("area", F.lit(1.0)))


#: Directions whose extremes bound the points that can be vertices of a hull, in turning order.
COMPASS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _chain(points: pd.DataFrame) -> pd.DataFrame:
    """Vertices of the convex hull, by the monotone chain; points on an edge aren't."""
    points = points.sort_values(["x", "y", "pt"]).drop_duplicates(["x", "y"])
    xy, keep = points[["x", "y"]].to_numpy(), set()
    for way in (range(len(xy)), range(len(xy) - 1, -1, -1)):
        chain: list[int] = []
        for i in way:
            while len(chain) > 1:
                (ax, ay), (bx, by), (cx, cy) = xy[chain[-2]], xy[chain[-1]], xy[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 1e-9:
                    break
                chain.pop()
            chain.append(i)
        keep.update(chain)
    return points.iloc[sorted(keep)]


def hull(points: DataFrame, pieces: int = 64) -> DataFrame:
    """(tp, pt, x, y) of the vertices of each frame's convex hull; of points in one place the least ``pt``.

    Points inside the polygon of a frame's extremes in eight directions are dropped first. The others
    meet in ``pieces`` groups a frame, whose vertices then meet, so that a very large frame is split. Points without a place are left out.
    """
    points = points.select("tp", "pt", "x", "y").dropna(subset=["tp", "x", "y"])
    place = F.struct("x", "y")
    ends = points.groupBy("tp").agg(F.array(*[F.max_by(place, F.struct(a * F.col("x") + b * F.col("y"), "x", "y")) for a, b in COMPASS]).alias("v"))
    sides = [(F.col("v")[i], F.col("v")[(i + 1) % len(COMPASS)]) for i in range(len(COMPASS))]
    left = [(b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"]) > 1e-6 for a, b in sides]
    proper = [a != b for a, b in sides]
    inside, some = F.lit(True), F.lit(False)
    for turn, real in zip(left, proper, strict=True):
        inside, some = inside & (turn | ~real), some | real
    rest = points.join(ends, "tp").filter(~(inside & some)).drop("v")
    schema = rest.schema
    rest = rest.withColumn("piece", F.pmod(F.xxhash64("pt"), F.lit(pieces)))
    part = rest.groupBy("tp", "piece").applyInPandas(lambda own: _chain(own)[["tp", "pt", "x", "y"]], schema)
    return part.groupBy("tp").applyInPandas(_chain, schema)
