"""A store of grid tables: one Parquet folder each, by tile, read with the columns and tables that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a grid and the columns that each must have.
TABLES = {
    "points": ("tile", "tp", "pt", "track", "x", "y"),
    "links": ("tile", "tp", "pt1", "pt2"),
    "edges": ("tile", "tp", "a", "b"),
    "triangles": ("tile", "tp", "a", "b", "c"),
    "perimeters": ("tile", "tp", "loop", "pos", "pt"),
    "fields": ("tile", "tp", "pt"),
    "persistence": ("tile", "track"),
    "scales": ("tile", "space_scale", "time_scale"),
}


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables that are given; a table or column that the store doesn't know or misses is an error."""
    for name, df in tables.items():
        missing = set(TABLES[name]) - set(df.columns) if name in TABLES else {name}
        if missing:
            raise ValueError(f"{name} has no {sorted(missing)}")
    for name, df in tables.items():
        df.write.partitionBy("tile").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, tile: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """A table with the named columns; tile and times reach the scan as partition and row-group filters."""
    rows = spark.read.parquet(f"{folder}/{name}")
    if tile is not None:
        rows = rows.filter(F.col("tile") == tile)
    for bound, keep in ((first, lambda b: F.col("tp") >= b), (last, lambda b: F.col("tp") <= b)):
        if bound is not None:
            rows = rows.filter(keep(bound))
    return rows.select(*(columns or [c for c in rows.columns]))
