"""Operators over pixel rows (image, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contrast(pixels: DataFrame) -> DataFrame:
    """Values rescaled to 0..1 in each image; a flat image is 0 or 1 by its value."""
    own = Window.partitionBy("image")
    lo, hi = F.min("value").over(own), F.max("value").over(own)
    flat = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    return pixels.withColumn("value", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(flat))


def block_mean(pixels: DataFrame, n: int) -> DataFrame:
    block = [F.floor(F.col(c) / n).cast("int").alias(c) for c in ("row", "col")]
    return pixels.groupBy("image", *block).agg((F.sum("value") / (n * n)).alias("value"))


def peaks(pixels: DataFrame, distance: int, threshold: float) -> DataFrame:
    """Pixels above ``threshold`` that are the first greatest within ``distance`` rows and columns, by value, row, column.

    Pixels are spread over the rows they reach, and a row's are windows over its columns; one row of an image is held at a time.
    """
    near = F.explode(F.sequence(F.lit(-distance), F.lit(distance)))
    spread = pixels.select("image", "row", "col", "value", near.alias("i")).withColumn("at", F.col("row") + F.col("i"))
    line = Window.partitionBy("image", "at").orderBy("col")
    most = lambda rows, a, b: F.coalesce(F.max(F.when(rows, F.col("value"))).over(line.rangeBetween(a, b)), F.lit(float("-inf")))
    own = F.col("i") == 0
    #: A pixel in an earlier place wins with an equal value, one in the same or a later place only with a greater. A copy with i > 0 is of an earlier row.
    spread = spread.withColumns({"before": F.greatest(most(F.col("i") > 0, -distance, distance), most(own, -distance, -1)), "after": F.greatest(most(F.col("i") < 0, -distance, distance), most(own, 0, distance))})
    best = spread.filter(own & (F.col("value") > threshold) & (F.col("before") < F.col("value")) & (F.col("after") <= F.col("value")))
    return best.select("image", "row", "col", "value")


def ensemble(responses: DataFrame, weights: DataFrame, how: str = "mean") -> DataFrame:
    """Weighted responses of detectors (detector, image, row, col, value) combined per pixel and clipped to 0..1."""
    rows = responses.join(F.broadcast(weights), "detector").withColumn("v", F.col("value") * F.col("weight"))
    f = F.avg if how == "mean" else F.max
    return rows.groupBy("image", "row", "col").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f("v"))).alias("value"))


def correlation(pixels: DataFrame, image: str) -> DataFrame:
    """Pearson correlation of every image with ``image`` over the pixels that both have: (image, n, correlation); null where a side is constant."""
    base = pixels.filter(F.col("image") == image).select("row", "col", F.col("value").alias("base"))
    rows = pixels.join(base, ["row", "col"]).groupBy("image").agg(F.count("*").alias("n"), F.corr("value", "base").alias("correlation"))
    return rows.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))


def median_filter(pixels: DataFrame, distance: int) -> DataFrame:
    """Median of the pixels that exist within ``distance`` rows and columns of each."""
    near = F.explode(F.sequence(F.lit(-distance), F.lit(distance)))
    spread = pixels.withColumn("i", near).withColumn("j", near).select("image", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"), "value", ((F.col("i") == 0) & (F.col("j") == 0)).alias("own"))
    return spread.groupBy("image", "row", "col").agg(F.median("value").alias("value"), F.bool_or("own").alias("own")).filter("own").drop("own")


def trimmed(pixels: DataFrame, cutoff: float, padding: int = 0) -> DataFrame:
    """Pixels between the first and last row and column with a value above ``cutoff``, and ``padding`` around; empty images go."""
    own, bright = Window.partitionBy("image"), F.col("value") > cutoff
    out = pixels
    for c in ("row", "col"):
        for name, f in (("min", F.min), ("max", F.max)):
            out = out.withColumn(f"{c}_{name}", f(F.when(bright, F.col(c))).over(own))
    for c in ("row", "col"):
        out = out.filter(F.col(c).between(F.col(f"{c}_min") - padding, F.col(f"{c}_max") + padding))
    return out.select(*pixels.columns)


def equalised(pixels: DataFrame, levels: int = 256) -> DataFrame:
    """Values replaced by the share of their image's pixels at or below their level; ``levels`` even levels of 0..1 after ``contrast``."""
    rows = contrast(pixels).withColumn("level", F.least(F.floor(F.col("value") * levels), F.lit(levels - 1)))
    counts = rows.groupBy("image", "level").agg(F.count("*").alias("n"))
    own = Window.partitionBy("image")
    share = F.sum("n").over(own.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(own)
    return rows.join(counts.select("image", "level", share.alias("share")), ["image", "level"]).select("image", "row", "col", F.col("share").alias("value"))


def expanded(pixels: DataFrame, n: int) -> DataFrame:
    """Each pixel as n by n pixels of its value."""
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return pixels.withColumn("i", each).withColumn("j", each).select("image", (F.col("row") * n + F.col("i")).alias("row"), (F.col("col") * n + F.col("j")).alias("col"), "value")


def local_intensity(points: DataFrame, pixels: DataFrame, least: float) -> DataFrame:
    """Points (image, pt, row, col) whose mean over the 4 by 4 block from two before to one after is ``least`` or more, as ``intensity``."""
    near = F.explode(F.sequence(F.lit(-2), F.lit(1)))
    block = points.withColumn("i", near).withColumn("j", near).select("image", "pt", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col"))
    return block.join(pixels, ["image", "row", "col"]).groupBy("image", "pt").agg(F.avg("value").alias("intensity")).filter(F.col("intensity") >= least)


def disk_mask(points: DataFrame, radius: int) -> DataFrame:
    """Pixels (image, row, col) within ``radius`` of a point, each with its closeness 1 - distance / (radius + 1) to the nearest."""
    near = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = points.withColumn("i", near).withColumn("j", near).withColumn("d", F.sqrt(F.pow("i", 2) + F.pow("j", 2))).filter(F.col("d") <= radius)
    return spread.groupBy("image", (F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).agg((1 - F.min("d") / (radius + 1)).alias("closeness"))


def circles(points: DataFrame, radius: float, vertices: int) -> DataFrame:
    """(image, pt, vertex, x, y): even vertices of a circle around each point, from the angle 0."""
    turn = F.col("vertex") * 2 * F.pi() / vertices
    rows = points.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1))))
    return rows.select("image", "pt", "vertex", (F.col("col") + radius * F.cos(turn)).alias("x"), (F.col("row") + radius * F.sin(turn)).alias("y"))


def box_mask(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels (image, row, col) inside at least one box (image, r0, r1, c0, c1), both ends included."""
    rows = boxes.select("image", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("image", "row", F.explode(F.sequence("c0", "c1")).alias("col")).distinct()
    return pixels.select("image", "row", "col").join(rows, ["image", "row", "col"], "left_semi")


def overlap_search(fixed: DataFrame, moving: DataFrame, search: int, least: int = 5) -> DataFrame:
    """For each image of ``moving``, every shift of up to ``search`` rows and columns with at least ``least`` shared pixels, by correlation: (image, dr, dc, n, similarity, rank)."""
    shift = F.explode(F.sequence(F.lit(-search), F.lit(search)))
    moved = moving.withColumn("dr", shift).withColumn("dc", shift).select("image", "dr", "dc", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col("value").alias("other"))
    both = moved.join(fixed.select("row", "col", "value"), ["row", "col"]).groupBy("image", "dr", "dc")
    found = both.agg(F.count("*").alias("n"), F.corr("value", "other").alias("similarity")).filter(F.col("n") >= least).withColumn("similarity", F.when(~F.isnan("similarity"), F.round("similarity", 9)))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("image").orderBy(F.desc_nulls_last("similarity"), "dr", "dc")))


def roi_values(pixels: DataFrame, rois: DataFrame, how=F.avg) -> DataFrame:
    """Any aggregate ``how`` of the pixels inside each region (roi, image, x0, y0, x1, y1, v: polygon of struct<x,y> in column and row).

    A region's box is laid out as pixels, so that the search is an equi-join; regions without pixels have null.
    """
    from fieldtrace.functions import geometry

    cells = rois.withColumn("row", F.explode(F.sequence(F.floor("y0").cast("int"), F.ceil("y1").cast("int")))).withColumn("col", F.explode(F.sequence(F.floor("x0").cast("int"), F.ceil("x1").cast("int"))))
    inside = cells.join(pixels, ["image", "row", "col"]).filter(geometry.contains(F.col("v"), F.col("col").cast("double"), F.col("row").cast("double")))
    found = inside.groupBy("roi", "image").agg(how("value").alias("value"), F.count("*").alias("n"))
    return rois.select("roi", "image").join(found, ["roi", "image"], "left").na.fill({"n": 0})


def polygon_mask(images: DataFrame, rows: int, cols: int, polygons: list) -> DataFrame:
    """(image, row, col, marked): whether a pixel of the grid lies in any of the polygons."""
    from fieldtrace.functions import geometry

    grid = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    marked = F.lit(False)
    for v in polygons:
        marked = marked | geometry.contains(geometry.polygon(*v), F.col("col").cast("double"), F.col("row").cast("double"))
    return grid.withColumn("marked", marked)


def patches(pixels: DataFrame, size: int) -> DataFrame:
    """All windows of ``size`` rows and columns that are full: (image, row, col, n, mean), by their first corner."""
    back = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    spread = pixels.withColumn("i", back).withColumn("j", back).groupBy("image", (F.col("row") - F.col("i")).alias("row"), (F.col("col") - F.col("j")).alias("col"))
    return spread.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).filter(F.col("n") == size * size)


def patch_labels(pixels: DataFrame, size: int, level: float, share: float) -> DataFrame:
    """Label of each full window: whether ``share`` of its pixels are above ``level``."""
    marked = patches(pixels.withColumn("value", (F.col("value") > level).cast("double")), size)
    return marked.select("image", "row", "col", F.col("mean").alias("marked"), (F.col("mean") >= share).alias("label"))


def padded(pixels: DataFrame, rows: int, cols: int, pad: int) -> DataFrame:
    """Images of ``rows`` by ``cols`` with ``pad`` zeros on all sides."""
    grid = pixels.select("image").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows + 2 * pad - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols + 2 * pad - 1))))
    moved = pixels.select("image", (F.col("row") + pad).alias("row"), (F.col("col") + pad).alias("col"), "value")
    return grid.join(moved, ["image", "row", "col"], "left").na.fill({"value": 0.0})


def cropped(pixels: DataFrame, rows: int, cols: int, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels of [r0, r1) by [c0, c1), counted anew; negative bounds count from the end."""
    r0, r1 = (b + rows if b < 0 else b for b in (r0, r1))
    c0, c1 = (b + cols if b < 0 else b for b in (c0, c1))
    keep = pixels.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return keep.select("image", (F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "value")


def transposed(pixels: DataFrame) -> DataFrame:
    return pixels.select("image", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def noisy(pixels: DataFrame, seed: str, share: float) -> DataFrame:
    """A ``share`` of the pixels, fixed by ``seed``, becomes 0 or 1."""
    from .reports import uniform

    u = lambda name: uniform(seed, name, F.col("image"), F.col("row"), F.col("col"))
    return pixels.withColumn("value", F.when(u("where") < share, F.when(u("what") < 0.5, 0.0).otherwise(1.0)).otherwise(F.col("value")))


def inner_peaks(pixels: DataFrame, images: DataFrame, distance: int, threshold: float) -> DataFrame:
    """(image, x, y, score): ``peaks`` at least ``distance`` away from all edges of their image (image, rows, cols); x from the left and y from below in shares of the image's size."""
    found = peaks(pixels, distance, threshold).join(images, "image")
    inside = [F.col(c).between(distance, F.col(f"{c}s") - 1 - distance) for c in ("row", "col")]
    return found.filter(inside[0] & inside[1]).select("image", (F.col("col") / F.col("cols")).alias("x"), (1 - F.col("row") / F.col("rows")).alias("y"), F.col("value").alias("score"))


def rescaled(pixels: DataFrame, n: int) -> DataFrame:
    """Block means of ``n`` by ``n`` pixels, stretched to 0..1 in each image; a flat image is 0."""
    own = Window.partitionBy("image")
    lo, hi = F.min("value").over(own), F.max("value").over(own)
    return block_mean(pixels, n).withColumn("value", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.0))
