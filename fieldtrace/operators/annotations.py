"""Annotation boxes (file, sel_class, x0, y0, x1, y1): normalised, de-duplicated, replaced, cleared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
LEAST = 1e-5


def normalised(boxes: DataFrame) -> DataFrame:
    """Corners in order; boxes without extent go."""
    order = {f"{c}{i}": f(f"{c}0", f"{c}1") for c in "xy" for i, f in ((0, F.least), (1, F.greatest))}
    return boxes.withColumns(order).filter((F.col("x1") - F.col("x0") >= LEAST) & (F.col("y1") - F.col("y0") >= LEAST))


def deduplicated(boxes: DataFrame) -> DataFrame:
    """Of boxes equal to within the tolerance's grid one stays for each file and class."""
    keys = [F.round(F.col(c) / LEAST).cast("long").alias(f"_{c}") for c in BOX]
    rows = normalised(boxes).select("*", *keys)
    return rows.groupBy("file", "sel_class", *[f"_{c}" for c in BOX]).agg(F.min(F.struct(*BOX)).alias("b")).select("file", "sel_class", "b.*")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the files in ``new`` are those of ``new``."""
    return old.join(new.select("file").distinct(), "file", "left_anti").unionByName(new)


def cleared(boxes: DataFrame, file: int) -> DataFrame:
    return boxes.filter(F.col("file") != file)


def files(boxes: DataFrame) -> DataFrame:
    """Each file that has annotations, with their number and classes."""
    return boxes.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("sel_class").alias("classes"))
