"""Operators over whole images of pixel rows (image, row, col, value): distance maps, contrast by tiles, erosion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pixels as P

#: Rows of an image whose distances are found in one group.
BAND = 64


def grid(images: DataFrame) -> DataFrame:
    """Every pixel (image, row, col) of ``images`` (image, rows, cols)."""
    rows = images.filter("rows > 0 and cols > 0").select("image", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols")
    return rows.select("image", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))


def _envelope(heights: np.ndarray, step: float) -> np.ndarray:
    """At each place the least of ``heights[k] + (step * (place - k))**2``, by the lower envelope of these parabolas."""
    some = np.flatnonzero(np.isfinite(heights)).tolist()
    if not some:
        return np.full(len(heights), np.nan)
    h, s2 = heights.tolist(), step * step
    lead, starts = [some[0]], [-np.inf]
    for k in some[1:]:
        while True:
            j = lead[-1]
            cross = ((h[k] - h[j]) / s2 + k * k - j * j) / (2 * (k - j))
            if cross > starts[-1]:
                break
            lead.pop()
            starts.pop()
        lead.append(k)
        starts.append(cross)
    at = np.arange(len(h))
    own = np.array(lead)[np.searchsorted(np.array(starts), at, "left") - 1]
    return heights[own] + s2 * (at - own) ** 2


def distance_map(images: DataFrame, marks: DataFrame, row_step: float = 1.0, col_step: float = 1.0) -> DataFrame:
    """(image, row, col, distance): from every pixel of ``images`` (image, rows, cols) to the nearest of ``marks`` (image, row, col).

    Exact in two passes: the nearest mark of a pixel's column by windows, then along its row the lower envelope of parabolas;
    the work is the number of pixels, however far marks are. Images without marks have null; marks outside don't count.
    """
    every = grid(images).join(marks.select("image", "row", "col", F.lit(True).alias("mark")).distinct(), ["image", "row", "col"], "left")
    order = Window.partitionBy("image", "col").orderBy("row")
    here = F.when(F.col("mark"), F.col("row"))
    above = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(here, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    nearest = F.least(F.col("row") - above, below - F.col("row"))
    columns = every.select("image", "row", "col", F.pow(nearest * row_step, 2).cast("double").alias("height"))

    def band(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("col", "ascending")])
        row = table.column("row").to_numpy()
        heights = table.column("height").to_numpy(zero_copy_only=False).astype(float)
        heights = np.where(np.isnan(heights), np.inf, heights)
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
        found = np.concatenate([_envelope(heights[a:b], col_step) for a, b in zip(cuts, cuts[1:], strict=False)])
        return pa.table({c: table.column(c) for c in ("image", "row", "col")} | {"distance": pa.array(np.sqrt(found), from_pandas=True)})

    kind = columns.schema["image"].dataType.simpleString()
    return columns.groupBy("image", F.floor(F.col("row") / BAND).alias("band")).applyInArrow(band, f"image {kind}, row int, col int, distance double")


def peak_map(images: DataFrame, marks: DataFrame, window_rows: int = 32, window_cols: int = 32, sharpness: float = 8.0) -> DataFrame:
    """(image, row, col, value): 1 at a mark, falling to 0 within a window's size over ``sharpness``; images without marks are 0."""
    far = distance_map(images, marks, sharpness / window_rows, sharpness / window_cols)
    return far.select("image", "row", "col", F.coalesce(F.greatest(1 - F.col("distance"), F.lit(0.0)), F.lit(0.0)).alias("value"))


def percentile_contrast(pixels: DataFrame, low: float = 0.02, high: float = 0.98, least: float = 1e-5) -> DataFrame:
    """Values between two percentiles of their image rescaled to 0..1, those outside cut; an image without contrast between them is 0."""
    rows = P.contrast(pixels)
    ends = rows.groupBy("image").agg(F.percentile("value", [low, high]).alias("p")).select("image", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    value = F.when(F.col("hi") - F.col("lo") < least, 0.0).otherwise(F.least(F.greatest((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)))
    return rows.join(ends, "image").select("image", "row", "col", value.alias("value"))


def adaptive_contrast(pixels: DataFrame, size: int, clip: float = 0.03, levels: int = 256) -> DataFrame:
    """Values equalised within tiles of ``size`` rows and columns and blended between the four nearest tiles.

    A tile's histogram has ``levels`` even levels of 0..1 after ``contrast``. A level counts up to ``clip`` of the tile's pixels
    (one at least); what is above is dealt evenly to all levels. A pixel's value is the share at or below
    its level, blended by its place between the centres of tiles; outside the outer centres the nearest tiles count alone.
    """
    rows = P.contrast(pixels).withColumn("level", F.least(F.floor(F.col("value") * levels), F.lit(levels - 1)).cast("int"))
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    counts = rows.groupBy("image", tile("row").alias("tr"), tile("col").alias("tc"), "level").agg(F.count("*").alias("n"))
    own = Window.partitionBy("image", "tr", "tc")
    most = F.greatest(F.floor(clip * F.sum("n").over(own)), F.lit(1))
    counts = counts.withColumn("all", F.sum("n").over(own)).withColumn("kept", F.least(F.col("n"), most))
    tiles = counts.groupBy("image", "tr", "tc").agg(F.max("all").alias("all"), (F.max("all") - F.sum("kept")).alias("excess"), F.map_from_entries(F.collect_list(F.struct("level", "kept"))).alias("kept"))
    dense = tiles.select("image", "tr", "tc", "all", "excess", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.coalesce(F.col("kept")[k], F.lit(0)))).alias("level", "kept"))
    share = (F.sum("kept").over(own.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) + F.col("excess") * (F.col("level") + 1) / levels) / F.col("all")
    maps = dense.select("image", "tr", "tc", "level", share.alias("share"))
    ends = counts.groupBy("image").agg(F.max("tr").alias("r_last"), F.max("tc").alias("c_last"))

    def sides(c: str, last: str) -> Column:
        """The two tiles around a pixel along one axis, each with its weight."""
        place = (F.col(c) + 0.5) / size - 0.5
        low = F.floor(place)
        part = place - low
        bound = lambda v: F.least(F.greatest(v, F.lit(0)), F.col(last)).cast("int")
        return F.array(F.struct(bound(low).alias("t"), (1 - part).alias("w")), F.struct(bound(low + 1).alias("t"), part.alias("w")))

    near = rows.join(ends, "image").select("image", "row", "col", "level", F.explode(sides("row", "r_last")).alias("r"), sides("col", "c_last").alias("cs")).select("image", "row", "col", "level", "r", F.explode("cs").alias("c"))
    near = near.select("image", "row", "col", "level", F.col("r.t").alias("tr"), F.col("c.t").alias("tc"), (F.col("r.w") * F.col("c.w")).alias("w")).filter("w > 0")
    return near.join(maps.hint("merge"), ["image", "tr", "tc", "level"]).groupBy("image", "row", "col").agg(F.sum(F.col("w") * F.col("share")).alias("value"))


def eroded(mask: DataFrame, times: int = 1) -> DataFrame:
    """Pixels (image, row, col) of a mask whose four neighbours are in it too, ``times`` times over; the border of an image isn't in it."""
    mask = mask.select("image", "row", "col").distinct()
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    for _ in range(times):
        spread = mask.withColumn("o", F.explode(around)).select("image", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
        mask = spread.groupBy("image", "row", "col").agg(F.count("*").alias("n")).filter("n = 5").drop("n")
    return mask


def trimmed(pixels: DataFrame, images: DataFrame, cutoff: float = 0.0, padding: int = 0, erode: int = 0, axes: tuple[str, ...] = ("row", "col"), symmetric: tuple[str, ...] = ()) -> DataFrame:
    """Pixels inside the bounds of those above ``cutoff`` that are left after ``erode`` erosions, with ``padding`` around, cut at the image's edge.

    ``images`` has (image, rows, cols). Along the ``axes`` only; a ``symmetric`` axis loses the lesser of its two margins on both
    sides. Images of which nothing is left have no row.
    """
    left = eroded(pixels.filter(F.col("value") > cutoff), erode)
    ends = left.groupBy("image").agg(*[f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))]).join(images, "image")
    out = pixels.join(ends, "image")
    for c in axes:
        size = F.col(f"{c}s")
        lo, hi = F.greatest(F.col(f"{c}_lo") - padding, F.lit(0)), F.least(F.col(f"{c}_hi") + padding + 1, size)
        if c in symmetric:
            margin = F.greatest(F.least(lo, size - hi), F.lit(0))
            lo, hi = margin, size - margin
        out = out.filter((F.col(c) >= lo) & (F.col(c) < hi))
    return out.select(*pixels.columns)
