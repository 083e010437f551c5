"""Places of rows in an order of the whole table, without a task that sees all rows.

Rows are dealt to stretches of the order; only one count a stretch meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches are bounded by 2**BITS - 1 percentiles, or by up to 2**MOST_BITS - 1 where they would else hold more than ROWS rows.
BITS, MOST_BITS, ROWS = 8, 12, 4_000_000


def bounds(rows: DataFrame, by: str) -> list:
    """Percentiles of a number, ascending, of about equal numbers of rows; none of no rows."""
    marks = [i / 2**MOST_BITS for i in range(1, 2**MOST_BITS)]
    found, n = rows.agg(F.percentile_approx(by, marks, 10000), F.count(by)).first()
    every = 2 ** (MOST_BITS - min(MOST_BITS, max(BITS, (n // ROWS).bit_length())))
    return (found or [])[every - 1 :: every]


def stretch(by: str, edges: list) -> Column:
    """Number of a value's stretch, ascending. A value that is itself a bound has an odd number and is alone there; null is in the first."""
    if not edges:
        return F.lit(0)
    table = F.array(*[F.lit(e) for e in edges])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) < F.col(by), step).otherwise(0))
    return 2 * below + F.when(F.get(table, below) == F.col(by), 1).otherwise(0)


def placed(rows: DataFrame, stretches: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: place from 0 in the order (stretches, order), and ``_n``, the number of rows."""
    before = Window.orderBy(*stretches).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*stretches).agg(F.count("*").alias("_c"))
    counts = counts.select(*stretches, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*stretches).orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(counts), stretches).withColumn(name, F.col("_own") - 1 + F.col("_before")).drop("_own", "_before")


def ranked(rows: DataFrame, value: str, key: str, name: str = "rank") -> DataFrame:
    """``name``: place from 0 in the order (value, key), nulls first, and ``_n``, the number of rows.

    Where very many rows share a value, a numeric ``key`` splits them further.
    """
    rows = rows.withColumn("_a", stretch(value, bounds(rows, value)))
    tied = F.col("_a") % 2 == 1
    numeric = dict(rows.dtypes)[key] not in ("string", "binary", "boolean")
    rows = rows.withColumn("_b", F.when(tied, stretch(key, bounds(rows.filter(tied), key))).otherwise(0) if numeric else F.lit(0))
    return placed(rows.na.fill({"_a": 0, "_b": 0}), ["_a", "_b"], [value, key], name).drop("_a", "_b")


def previous(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``before_*``: ``columns`` of the row before, from the greatest ``by`` down; null in the first row. Values of ``by`` are distinct."""
    rows = rows.withColumn("_a", stretch(by, bounds(rows, by)))
    own = Window.partitionBy("_a").orderBy(F.desc(by))
    ends = rows.groupBy("_a").agg(F.min_by(F.struct(*columns), by).alias("_last"))
    ends = ends.select("_a", F.lag("_last").over(Window.orderBy(F.desc("_a"))).alias("_last"))
    first = F.row_number().over(own) == 1
    out = rows.join(F.broadcast(ends), "_a")
    return out.withColumns({f"before_{c}": F.when(first, F.col("_last")[c]).otherwise(F.lag(c).over(own)) for c in columns}).drop("_a", "_last")
