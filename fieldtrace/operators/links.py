"""Links between frames by a named or given rule, and the chains they make.

A rule is a function of (points, radius, step) that gives (tp, pt1, pt2) between each frame and the ``step``-th after it.
Functions of this module whose names begin with ``link_by_`` are found by the rest of their name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking, softassign, spatial

PREFIX = "link_by_"


def link_by_nearest(points: DataFrame, radius: float, step: int = 1) -> DataFrame:
    return spatial.nearest_links(points, spatial.earlier(points, step), radius)


def link_by_mutual(points: DataFrame, radius: float, step: int = 1) -> DataFrame:
    return spatial.mutual_links(points, spatial.earlier(points, step), radius)


def link_by_matched(points: DataFrame, radius: float, step: int = 1) -> DataFrame:
    return linking.matched(spatial.crowd_pairs(points, radius, step), radius)


def link_by_soft(points: DataFrame, radius: float, step: int = 1) -> DataFrame:
    return softassign.soft_links(points, radius, step)


def rules() -> dict[str, Callable[[DataFrame, float, int], DataFrame]]:
    """All rules by name."""
    return {name.removeprefix(PREFIX): f for name, f in globals().items() if name.startswith(PREFIX)}


def links_of(points: DataFrame, rule: str | Callable[[DataFrame, float, int], DataFrame], radius: float, step: int = 1) -> DataFrame:
    """(tp, pt1, pt2) by a rule's name, in any case, or a callable; another name is a KeyError, anything else a TypeError."""
    if isinstance(rule, str):
        rule = rules()[rule.lower()]
    elif not callable(rule):
        raise TypeError(f"a rule is a name or a callable, not {rule!r}")
    return rule(points, radius, step).select("tp", "pt1", "pt2")


def linked_by(points: DataFrame, rule: str | Callable[[DataFrame, float, int], DataFrame], radius: float, step: int = 1) -> DataFrame:
    """(tp, pt, root_tp, root_pt, depth): the chain of each point over frames that lie ``step`` apart; series of frames in between are chains of their own."""
    series, frame = F.pmod("tp", F.lit(step)), lambda: F.floor((F.col("tp") - F.pmod("tp", F.lit(step))) / step).cast("int")
    node = lambda pt: F.struct(series.alias("s"), F.col(pt).alias("p"))
    own = points.select(frame().alias("tp"), node("pt").alias("pt"))
    links = links_of(points, rule, radius, step).select(frame().alias("tp"), node("pt1").alias("pt1"), node("pt2").alias("pt2"))
    out = linking.chains(own, links)
    back = lambda c, p: (F.col(c) * step + F.col(f"{p}.s")).cast("int")
    return out.select(back("tp", "pt").alias("tp"), F.col("pt.p").alias("pt"), back("root_tp", "root_pt").alias("root_tp"), F.col("root_pt.p").alias("root_pt"), "depth")
