"""Annotations without near-duplicates: rows of one file and class whose fields all differ by less than a tolerance."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .annotations import LEAST, normalised
from .written import written

BOX, ELLIPSE, POINT = ("x0", "y0", "x1", "y1"), ("x", "y", "a", "b", "angle"), ("x", "y")


def normal_ellipses(rows: DataFrame) -> DataFrame:
    """The greater axis first, which turns the ellipse by a quarter, and the angle within one turn; ellipses without extent go."""
    swap = F.col("a") < F.col("b")
    angle = F.pmod(F.when(swap, F.col("angle") + F.pi() / 2).otherwise(F.col("angle")), 2 * F.pi())
    out = rows.withColumns({"a": F.greatest("a", "b"), "b": F.least("a", "b"), "angle": angle})
    return out.filter(F.col("b") >= LEAST)


def near_rows(rows: DataFrame, fields: tuple[str, ...], keys: list[str], order: str, tolerance: float) -> DataFrame:
    """(earlier, later): pairs of rows, by ``order``, of equal keys whose fields all differ by less than ``tolerance``.

    Every field has two grids of twice the tolerance, shifted by it: two near values share a cell of one of them, so a pair
    shares a cell of one combination of grids, also across any cell's edge. Cells are met by a hash and the rows then compared; the
    rows are spread to all combinations after their size is estimated, so the hint keeps them from being broadcast.
    """
    cell = lambda c, i: F.floor((F.col(c) + (tolerance if i else 0.0)) / (2 * tolerance))
    combined = F.array(*[F.xxhash64(*keys, F.lit(n), *[cell(c, i) for c, i in zip(fields, grids, strict=True)]) for n, grids in enumerate(product((0, 1), repeat=len(fields)))])
    spread = rows.select(*keys, *fields, F.col(order).alias("_o"), F.explode(combined).alias("_cell"))
    other = spread.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in fields], F.col("_o").alias("_p"), F.col("_cell").alias("_d"))
    equal = lambda k: F.coalesce(F.col(k) == F.col(f"_{k}"), F.col(k).isNull() & F.col(f"_{k}").isNull())
    same = [equal(k) for k in keys] + [F.abs(F.col(c) - F.col(f"_{c}")) < tolerance for c in fields]
    return spread.join(other.hint("merge"), reduce(and_, same, F.col("_cell") == F.col("_d")) & (F.col("_o") < F.col("_p"))).select(F.col("_o").alias("earlier"), F.col("_p").alias("later")).distinct()


def _lost(pairs: DataFrame) -> DataFrame:
    """Rows that a walk in order leaves out as near to one that it keeps: in every round, those near to a row that nothing earlier threatens."""
    todo = written(pairs)
    lost = todo.select("later").limit(0)
    while not todo.isEmpty():
        free = todo.select("earlier").join(todo.select(F.col("later").alias("earlier")), "earlier", "left_anti").distinct()
        now = written(todo.join(free, "earlier", "left_semi").select("later").distinct())
        lost = lost.union(now)
        todo = written(todo.join(now, "later", "left_anti").join(now.withColumnRenamed("later", "earlier"), "earlier", "left_anti"))
    return lost


def without_near(rows: DataFrame, fields: tuple[str, ...], order: str, keys: tuple[str, ...] = ("file", "sel_class"), tolerance: float = LEAST) -> DataFrame:
    """The first rows, by the distinct ``order``, of each set of near-duplicates; a row near only to one that went stays.

    Equal rows are told apart first, so that many copies of one annotation are one row in the search. Rows with a null field stay.
    """
    keys = list(keys)
    whole = reduce(and_, [F.col(c).isNotNull() for c in fields])
    first = written(rows.filter(whole).groupBy(*keys, *fields).agg(F.min(order).alias("_first")))
    lost = _lost(near_rows(first, fields, keys, "_first", tolerance))
    kept = first.select("_first").join(lost.withColumnRenamed("later", "_first"), "_first", "left_anti")
    out = rows.join(kept.withColumnRenamed("_first", order), order, "left_semi")
    return out.unionByName(rows.filter(~whole))


def distinct_boxes(rows: DataFrame, order: str) -> DataFrame:
    """Boxes with corners in order, without those that have no extent or are near an earlier one."""
    return without_near(normalised(rows), BOX, order)


def distinct_ellipses(rows: DataFrame, order: str) -> DataFrame:
    """Ellipses in normal form without near-duplicates; angles just under and over a full turn count as far apart."""
    return without_near(normal_ellipses(rows), ELLIPSE, order)


def distinct_points(rows: DataFrame, order: str) -> DataFrame:
    return without_near(rows, POINT, order)


def appended(old: DataFrame, new: DataFrame, fields: tuple[str, ...], order: str) -> DataFrame:
    """``old`` and the rows of ``new`` that aren't near to one of these or to an earlier new one; ``order`` is distinct within either."""
    both = old.withColumn("_turn", F.struct(F.lit(0).alias("s"), F.col(order).alias("o"))).unionByName(new.withColumn("_turn", F.struct(F.lit(1).alias("s"), F.col(order).alias("o"))))
    return without_near(both, fields, "_turn").drop("_turn")


def found(rows: DataFrame, file) -> DataFrame:
    """The annotations of one file."""
    return rows.filter(F.col("file") == F.lit(file))


def exists(rows: DataFrame, file) -> bool:
    """Whether a file has annotations."""
    return not found(rows, file).isEmpty()
