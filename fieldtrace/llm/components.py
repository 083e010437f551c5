"""Connected components by alternating large-star and small-star joins.

Edges stay in Spark. Each round is one aggregate and one join on a key that is unique on one side,
so a hub with very many edges can be split by adaptive skew joins. Lineage is cut every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, keep: str) -> DataFrame:
    """``keep`` large: link each larger neighbour of u to u's least neighbour; small: the others and u."""
    if keep == "large":
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if keep == "large":
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) edges of any orientable type -> (node, root): root is the least node of the component.

    Nodes without an edge are absent; null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges = cut(edges)
    before = _print(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = cut(_stars(_stars(edges, "large"), "small"))
        after = _print(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
