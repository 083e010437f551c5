"""Polygon expressions over arrays of struct<x,y>, closed by themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon(*vertices: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in vertices])


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once: what a lambda only mentions is worked out again for each element."""
    return F.transform(F.array(value), f)[0]


def _edges(v: Column) -> Column:
    """Each vertex with the next, the last with the first."""
    return once(v, lambda v: F.arrays_zip(v.alias("a"), F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1)).alias("b")))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + term(e))


def _sum(v: Column, term) -> Column:
    return _total(_edges(v), term)


def area(v: Column) -> Column:
    return F.abs(_sum(v, _cross)) / 2


def perimeter(v: Column) -> Column:
    return _sum(v, lambda e: F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]))


def centroid(v: Column) -> Column:
    """struct<x,y>; (0, 0) where the area is below 1e-5."""

    def of(edges: Column, twice: Column) -> Column:
        at = lambda c: F.when(F.abs(twice) / 2 < 1e-5, F.lit(0.0)).otherwise(_total(edges, lambda e: (e["a"][c] + e["b"][c]) * _cross(e)) / (3 * twice))
        return F.struct(at("x").alias("x"), at("y").alias("y"))

    return once(_edges(v), lambda edges: once(_total(edges, _cross), lambda twice: of(edges, twice)))


def contains(v: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the parity of edges right of it."""

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(_edges(v), F.lit(0), lambda s, e: s + crossing(e)) % 2 == 1


def scale(v: Column, factor: float) -> Column:
    moved = lambda p, c: F.struct((c["x"] + (p["x"] - c["x"]) * factor).alias("x"), (c["y"] + (p["y"] - c["y"]) * factor).alias("y"))
    return once(centroid(v), lambda c: F.transform(v, lambda p: moved(p, c)))


def by_angle(v: Column, mean: Column | None = None) -> Column:
    """Vertices in order of their angle around the mean vertex, or around ``mean`` (struct<x,y>)."""
    middle = lambda c: F.aggregate(v, F.lit(0.0), lambda s, p: s + p[c]) / F.size(v)
    mean = F.struct(middle("x").alias("x"), middle("y").alias("y")) if mean is None else mean
    keyed = once(mean, lambda m: F.transform(v, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def axes(v: Column) -> Column:
    """struct<major, minor>: greatest and least distance of a vertex from the centroid."""
    far = once(centroid(v), lambda c: F.transform(v, lambda p: F.hypot(p["x"] - c["x"], p["y"] - c["y"])))
    return once(far, lambda d: F.struct(F.array_max(d).alias("major"), F.array_min(d).alias("minor")))
