"""Registered queries on pixel rows and on timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import pixels, series
from fieldtrace.plans.catalogue import PIXELS, POINTS, query, r
from fieldtrace.sources import tables as T

BRIGHT = PIXELS + """, pk AS (SELECT image, "row" * 10 + col AS pt, "row", col FROM px WHERE value > 40)"""


def _bright(spark, sf_dir):
    """Bright pixels as points."""
    px = T.pixels(spark, sf_dir)
    return px, px.filter("value > 40").select("image", (F.col("row") * 10 + F.col("col")).alias("pt"), "row", "col")


@query("pixel_ensemble", f"""WITH {PIXELS}, de AS (SELECT image, "row", col, value / 50 * 0.9 AS v FROM px UNION ALL SELECT image, "row", col, (50 - value) / 40 * 1.2 FROM px WHERE col > 2)
  SELECT image, "row", col, round(greatest(0, least(1, avg(v))), 4) AS value FROM de GROUP BY ALL""")
def pixel_ensemble(spark, sf_dir):
    px = T.pixels(spark, sf_dir)
    first = px.withColumn("value", F.col("value") / 50).withColumn("detector", F.lit("a"))
    second = px.filter("col > 2").withColumn("value", (50 - F.col("value")) / 40).withColumn("detector", F.lit("b"))
    return pixels.ensemble(first.unionByName(second), spark.createDataFrame([("a", 0.9), ("b", 1.2)], "detector string, weight double"))


@query("pixel_equalised", f"""WITH {PIXELS}, m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image)),
  l AS (SELECT *, least(floor(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) WHEN value > 0 THEN 1 ELSE 0 END * 256), 255) AS level FROM m)
  SELECT image, "row", col, round(count(*) OVER (PARTITION BY image ORDER BY level) / count(*) OVER (PARTITION BY image), 4) AS value FROM l""")
def pixel_equalised(spark, sf_dir):
    return pixels.equalised(T.pixels(spark, sf_dir))


@query("pixel_expanded", f"""WITH {PIXELS} SELECT image, CAST("row" * 2 + i AS INTEGER) AS "row", CAST(col * 2 + j AS INTEGER) AS col, value FROM px, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j)""")
def pixel_expanded(spark, sf_dir):
    return pixels.expanded(T.pixels(spark, sf_dir), 2)


@query("local_intensity", f"""WITH {BRIGHT} SELECT p.image, p.pt, round(avg(x.value), 4) AS intensity FROM pk p JOIN px x ON x.image = p.image AND x."row" BETWEEN p."row" - 2 AND p."row" + 1 AND x.col BETWEEN p.col - 2 AND p.col + 1 GROUP BY ALL HAVING avg(x.value) >= 28""")
def local_intensity(spark, sf_dir):
    px, points = _bright(spark, sf_dir)
    return pixels.local_intensity(points, px, 28)


@query("disk_mask", f"""WITH {BRIGHT}, s AS (SELECT image, CAST("row" + i AS INTEGER) AS "row", CAST(col + j AS INTEGER) AS col, sqrt(i * i + j * j) AS d FROM pk, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j))
  SELECT image, "row", col, round(1 - min(d) / 3, 4) AS closeness FROM s WHERE d <= 2 GROUP BY ALL""")
def disk_mask(spark, sf_dir):
    return pixels.disk_mask(_bright(spark, sf_dir)[1], 2)


@query("peak_circles", f"""WITH {BRIGHT} SELECT image, pt, CAST(k AS INTEGER) AS vertex, round(col + 1.5 * cos(k * 2 * pi() / 8), 4) AS x, round("row" + 1.5 * sin(k * 2 * pi() / 8), 4) AS y FROM pk, (SELECT unnest(range(8)) AS k)""")
def peak_circles(spark, sf_dir):
    return pixels.circles(_bright(spark, sf_dir)[1], 1.5, 8)


@query("box_mask", f"""WITH {BRIGHT} SELECT image, "row", col FROM px WHERE EXISTS (SELECT 1 FROM pk WHERE pk.image = px.image AND px."row" BETWEEN pk."row" AND pk."row" + 1 AND px.col BETWEEN pk.col - 1 AND pk.col)""")
def box_mask(spark, sf_dir):
    px, points = _bright(spark, sf_dir)
    return pixels.box_mask(px, points.select("image", F.col("row").alias("r0"), (F.col("row") + 1).alias("r1"), (F.col("col") - 1).alias("c0"), F.col("col").alias("c1")))


@query("overlap_search", f"""WITH {PIXELS}, s AS (SELECT o.image, CAST(i AS INTEGER) AS dr, CAST(j AS INTEGER) AS dc, count(*) AS n, corr(f.value, o.value) AS c
  FROM px o, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), px f WHERE f.image = 'I0' AND f."row" = o."row" + i AND f.col = o.col + j GROUP BY ALL HAVING count(*) >= 5)
  SELECT image, dr, dc, n, round(CASE WHEN NOT isnan(c) THEN c END, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(CASE WHEN NOT isnan(c) THEN c END, 9) DESC NULLS LAST, dr, dc) = 1""")
def overlap_search(spark, sf_dir):
    px = T.pixels(spark, sf_dir)
    return pixels.overlap_search(px.filter("image = 'I0'"), px, 2).filter("rank = 1").drop("rank")


FRAMED = POINTS + """, fr AS (SELECT track, CAST(floor(t / 2880) AS BIGINT) AS frame, avg(x) * 0.3712345678 AS x FROM tp GROUP BY ALL),
  ev AS (SELECT track, f AS frame FROM (SELECT DISTINCT track FROM fr), (SELECT unnest(range(2, 15)) AS f)),
  pv AS (SELECT ev.*, (SELECT max(frame) FROM fr WHERE fr.track = ev.track AND fr.frame <= ev.frame) AS a, (SELECT min(frame) FROM fr WHERE fr.track = ev.track AND fr.frame >= ev.frame) AS b FROM ev),
  pa AS (SELECT pv.*, fa.x AS xa, fb.x AS xb FROM pv LEFT JOIN fr fa ON fa.track = pv.track AND fa.frame = a LEFT JOIN fr fb ON fb.track = pv.track AND fb.frame = b)"""


def _framed(spark, sf_dir):
    return T.track_points(spark, sf_dir).groupBy("track", F.floor(F.col("t") / 2880).alias("frame")).agg((F.avg("x") * 0.3712345678).alias("x"))


@query("padded_timeline", f"WITH {FRAMED} SELECT track, frame, round(CASE WHEN a = b THEN xa ELSE xa + (xb - xa) * (frame - a) / (b - a) END, 4) AS x FROM pa")
def padded_timeline(spark, sf_dir):
    return series.padded(_framed(spark, sf_dir), "x", 2, 14)


@query("extended_timeline", f"WITH {FRAMED} SELECT track, frame, round(CASE WHEN a IS NULL THEN xb WHEN b IS NULL OR a = b THEN xa ELSE xa + (xb - xa) * (frame - a) / (b - a) END, 4) AS x FROM pa")
def extended_timeline(spark, sf_dir):
    return series.padded(_framed(spark, sf_dir), "x", 2, 14, extrapolate=True)


@query("joined_tracks", f"WITH {POINTS} SELECT CASE WHEN track % 3 = 1 THEN track - 1 ELSE track END AS track, count(*) AS n, {r('min(x) AS low')} FROM tp GROUP BY 1")
def joined_tracks(spark, sf_dir):
    points = T.track_points(spark, sf_dir)
    joins = points.filter("track % 3 = 1").select("track", (F.col("track") - 1).alias("head")).distinct()
    return series.joined_tracks(points, joins).groupBy("track").agg(F.count("*").alias("n"), F.min("x").alias("low"))


@query("persistence_timeline", f"WITH {POINTS} SELECT CAST(floor(t / 1440) AS BIGINT) AS stretch, round(avg(CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END), 4) AS share, count(*) AS n FROM tp WHERE x IS NOT NULL GROUP BY 1")
def persistence_timeline(spark, sf_dir):
    return series.persistence_timeline(T.track_points(spark, sf_dir).withColumn("far", F.col("x") > 50), "far", 1440.0)


@query("padded_boxes", f"WITH {POINTS} SELECT track, greatest(floor(min(x)) - 5, 0)::DOUBLE AS x0, greatest(floor(min(y)) - 5, 0)::DOUBLE AS y0, least(ceil(max(x)) + 5, 300)::DOUBLE AS x1, least(ceil(max(y)) + 5, 90)::DOUBLE AS y1 FROM tp GROUP BY track")
def padded_boxes(spark, sf_dir):
    return series.padded_boxes(T.track_points(spark, sf_dir), 5, 300, 90)


@query("key_times", "WITH d AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tp FROM events) SELECT min(tp) AS first, CAST(round((min(tp) + max(tp)) / 2) AS INTEGER) AS middle, CASE WHEN max(tp) - min(tp) > 1 THEN max(tp) - 1 ELSE max(tp) END AS late FROM d")
def key_times(spark, sf_dir):
    return series.key_times(T.detections(spark, sf_dir))
