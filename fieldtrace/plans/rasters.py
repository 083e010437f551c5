"""Registered queries on whole images, annotations with tolerance, polygons over time, splines and link rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import links, pixels, polygons, rasters, softassign, splines, tolerance
from fieldtrace.plans.catalogue import FRAMES, PIXELS, RADIUS, query, r
from fieldtrace.plans.meshes import NEAR, _graph
from fieldtrace.sources import tables as T

MARKED = PIXELS + """, mk AS (SELECT image, "row", col FROM px WHERE value > 47), im AS (SELECT image, CAST(max("row") + 1 AS INTEGER) AS rows, CAST(max(col) + 1 AS INTEGER) AS cols FROM px GROUP BY image),
  gr AS (SELECT image, "row", CAST(unnest(range(cols)) AS INTEGER) AS col FROM (SELECT image, cols, CAST(unnest(range(rows)) AS INTEGER) AS "row" FROM im)),
  di AS (SELECT g.image, g."row", g.col, min(sqrt(power((g."row" - m."row") * 1.5, 2) + power((g.col - m.col) * 0.5, 2))) AS distance FROM gr g LEFT JOIN mk m ON m.image = g.image GROUP BY ALL)"""


def _marked(spark, sf_dir):
    px = T.pixels(spark, sf_dir)
    images = px.groupBy("image").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    return px, images, px.filter("value > 47")


@query("distance_map", f'WITH {MARKED} SELECT image, "row", col, {r("distance")} FROM di')
def distance_map(spark, sf_dir):
    _, images, marks = _marked(spark, sf_dir)
    return rasters.distance_map(images, marks, 1.5, 0.5)


@query("peak_map", f'WITH {MARKED} SELECT image, "row", col, round(coalesce(greatest(1 - distance, 0), 0), 4) AS value FROM di')
def peak_map(spark, sf_dir):
    _, images, marks = _marked(spark, sf_dir)
    return rasters.peak_map(images, marks, 2, 6, 3)


RESCALED = PIXELS + """, mm AS (SELECT image, "row", col, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image)),
  co AS (SELECT image, "row", col, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) WHEN value > 0 THEN 1.0 ELSE 0.0 END AS v FROM mm)"""


@query("pixel_percentile", f"""WITH {RESCALED}, q AS (SELECT image, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM co GROUP BY image)
  SELECT image, "row", col, round(CASE WHEN hi - lo < 1e-5 THEN 0 ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END, 4) AS value FROM co JOIN q USING (image)""")
def pixel_percentile(spark, sf_dir):
    return rasters.percentile_contrast(T.pixels(spark, sf_dir))


@query("pixel_adaptive", f"""WITH {RESCALED}, lv AS (SELECT image, "row", col, least(floor(v * 256), 255)::INTEGER AS level, "row" // 4 AS tr, col // 4 AS tc FROM co),
  hi AS (SELECT image, tr, tc, level, count(*) AS n FROM lv GROUP BY ALL), hc AS (SELECT *, sum(n) OVER t AS total, least(n, greatest(floor(0.1 * sum(n) OVER t), 1)) AS kept FROM hi WINDOW t AS (PARTITION BY image, tr, tc)),
  ti AS (SELECT image, tr, tc, max(total) AS total, max(total) - sum(kept) AS excess FROM hc GROUP BY ALL), de AS (SELECT *, unnest(range(256)) AS level FROM ti),
  sh AS (SELECT de.image, de.tr, de.tc, de.level, (sum(coalesce(kept, 0)) OVER (PARTITION BY de.image, de.tr, de.tc ORDER BY de.level) + excess * (de.level + 1) / 256) / de.total AS share FROM de LEFT JOIN hc USING (image, tr, tc, level)),
  la AS (SELECT image, max(tr) AS r1, max(tc) AS c1 FROM lv GROUP BY image), pl AS (SELECT *, ("row" + 0.5) / 4 - 0.5 AS pr, (col + 0.5) / 4 - 0.5 AS pc FROM lv JOIN la USING (image)),
  nb AS (SELECT image, "row", col, level, least(greatest(floor(pr) + i, 0), r1) AS tr, least(greatest(floor(pc) + j, 0), c1) AS tc,
    (CASE i WHEN 0 THEN 1 - (pr - floor(pr)) ELSE pr - floor(pr) END) * (CASE j WHEN 0 THEN 1 - (pc - floor(pc)) ELSE pc - floor(pc) END) AS w FROM pl, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
  SELECT image, "row", col, round(sum(w * share), 4) AS value FROM nb JOIN sh USING (image, tr, tc, level) GROUP BY image, "row", col""")
def pixel_adaptive(spark, sf_dir):
    return rasters.adaptive_contrast(T.pixels(spark, sf_dir), 4, 0.1)


@query("pixel_eroded", f"""WITH {PIXELS}, ma AS (SELECT image, "row", col FROM px WHERE value > 12)
  SELECT a.image, a."row", a.col FROM ma a JOIN ma b ON a.image = b.image AND abs(a."row" - b."row") + abs(a.col - b.col) <= 1 GROUP BY ALL HAVING count(*) = 5""")
def pixel_eroded(spark, sf_dir):
    return rasters.eroded(T.pixels(spark, sf_dir).filter("value > 12"))


@query("pixel_margins", f"""WITH {PIXELS}, ma AS (SELECT image, "row", col FROM px WHERE value > 12), er AS (SELECT a.image, a."row", a.col FROM ma a JOIN ma b ON a.image = b.image AND abs(a."row" - b."row") + abs(a.col - b.col) <= 1 GROUP BY ALL HAVING count(*) = 5),
  im AS (SELECT image, max("row") + 1 AS rows, max(col) + 1 AS cols FROM px GROUP BY image), bo AS (SELECT image, rows, cols, greatest(min("row") - 1, 0) AS r0, least(max("row") + 2, rows) AS r1, greatest(min(col) - 1, 0) AS c0, least(max(col) + 2, cols) AS c1 FROM er JOIN im USING (image) GROUP BY image, rows, cols)
  SELECT image, "row", col, value FROM px JOIN bo USING (image) WHERE "row" >= r0 AND "row" < r1 AND col >= greatest(least(c0, cols - c1), 0) AND col < cols - greatest(least(c0, cols - c1), 0)""")
def pixel_margins(spark, sf_dir):
    px, images, _ = _marked(spark, sf_dir)
    return rasters.trimmed(px, images, 12, 1, 1, symmetric=("col",))


#: Boxes of whole-number corners, each with a copy that is moved by 1e-6 or 7e-6, so that copies lie on both sides of cells' edges.
JITTERED = """jb AS (SELECT event_id AS o, user_id AS file, event_type AS sel_class, floor(value / 100) + (event_id % 3) * 3e-6 - 2e-6 AS x0, floor(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20) + (event_id % 2) * 1e-6 AS y0, 9.0 AS x1, 9.0 AS y1 FROM events)"""


def _jittered(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    jitter = lambda n, s: F.pmod("event_id", F.lit(n)) * s
    return T.read(spark, sf_dir, "events").select(F.col("event_id").alias("o"), F.col("user_id").alias("file"), F.col("event_type").alias("sel_class"), (F.floor(F.col("value") / 100) + jitter(3, 3e-6) - 2e-6).alias("x0"), (F.floor(k / 20) + jitter(2, 1e-6)).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"))


@query("boxes_without_near", f"WITH {JITTERED} SELECT a.o, a.file, a.sel_class, {r('a.x0 AS x0', 'a.y0 AS y0')} FROM jb a WHERE NOT EXISTS (SELECT 1 FROM jb b WHERE b.o < a.o AND b.file = a.file AND b.sel_class = a.sel_class AND abs(a.x0 - b.x0) < 1e-5 AND abs(a.y0 - b.y0) < 1e-5)")
def boxes_without_near(spark, sf_dir):
    return tolerance.distinct_boxes(_jittered(spark, sf_dir), "o").select("o", "file", "sel_class", "x0", "y0")


@query("ellipses_without_near", f"""WITH {JITTERED}, el AS (SELECT o, file, sel_class, x0 AS x, y0 AS y, greatest(1.0 + x0 + 1e-9, 3.0) AS a, least(1.0 + x0 + 1e-9, 3.0) AS b, CASE WHEN 1.0 + x0 + 1e-9 < 3.0 THEN 0.5 + pi() / 2 ELSE 0.5 END AS angle FROM jb)
  SELECT a.o, a.file, a.sel_class, {r('a.a AS a', 'a.b AS b', 'a.angle AS angle')} FROM el a WHERE NOT EXISTS (SELECT 1 FROM el b WHERE b.o < a.o AND b.file = a.file AND b.sel_class = a.sel_class AND abs(a.x - b.x) < 1e-5 AND abs(a.y - b.y) < 1e-5 AND abs(a.a - b.a) < 1e-5 AND abs(a.b - b.b) < 1e-5 AND abs(a.angle - b.angle) < 1e-5)""")
def ellipses_without_near(spark, sf_dir):
    rows = _jittered(spark, sf_dir).select("o", "file", "sel_class", F.col("x0").alias("x"), F.col("y0").alias("y"), (1.0 + F.col("x0") + 1e-9).alias("a"), F.lit(3.0).alias("b"), F.lit(0.5).alias("angle"))
    return tolerance.distinct_ellipses(rows, "o").select("o", "file", "sel_class", "a", "b", "angle")


@query("points_appended", f"""WITH {JITTERED}, pt AS (SELECT *, o % 4 > 0 AS fresh FROM jb) SELECT a.o, a.file, a.sel_class, {r('a.x0 AS x', 'a.y0 AS y')} FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE (b.fresh, b.o) < (a.fresh, a.o) AND b.file = a.file AND b.sel_class = a.sel_class AND abs(a.x0 - b.x0) < 1e-5 AND abs(a.y0 - b.y0) < 1e-5)""")
def points_appended(spark, sf_dir):
    rows = _jittered(spark, sf_dir).select("o", "file", "sel_class", F.col("x0").alias("x"), F.col("y0").alias("y"))
    return tolerance.appended(rows.filter("o % 4 = 0"), rows.filter("o % 4 > 0"), tolerance.POINT, "o")


@query("annotations_found", "SELECT event_id, event_type AS sel_class FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def annotations_found(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("sel_class"), F.col("user_id").alias("file"))
    return tolerance.found(rows, rows.agg(F.min("file")).first()[0]).drop("file")


@query("polygon_delta", f"""WITH {NEAR}, si AS (SELECT m.tp, m.pt1, m.pt2, 1 AS side, n.x1, n.y1, n.x2, n.y2 FROM mo m JOIN bo ON bo.tp = m.tp AND bo.pt = m.pt1 JOIN mo n ON n.tp = m.tp AND n.pt1 = bo.near
    UNION ALL SELECT m.tp, m.pt1, m.pt2, 2, n.x1, n.y1, n.x2, n.y2 FROM mo m JOIN bo ON bo.tp = m.tp + 1 AND bo.pt = m.pt2 JOIN mo n ON n.tp = m.tp AND n.pt2 = bo.near),
  me AS (SELECT *, count(*) OVER w AS n, atan2(y1 - avg(y1) OVER w, x1 - avg(x1) OVER w) AS t1, atan2(y2 - avg(y2) OVER w, x2 - avg(x2) OVER w) AS t2 FROM si WINDOW w AS (PARTITION BY tp, pt1, pt2, side)),
  nx AS (SELECT *, x1 * coalesce(lead(y1) OVER a, first(y1) OVER a) - y1 * coalesce(lead(x1) OVER a, first(x1) OVER a) AS c1, x2 * coalesce(lead(y2) OVER b, first(y2) OVER b) - y2 * coalesce(lead(x2) OVER b, first(x2) OVER b) AS c2
    FROM me WHERE n >= 3 WINDOW a AS (PARTITION BY tp, pt1, pt2, side ORDER BY t1, x1, y1), b AS (PARTITION BY tp, pt1, pt2, side ORDER BY t2, x2, y2)),
  pa AS (SELECT tp, pt1, pt2, side, count(*) AS n, avg(t2 - t1) AS turn, ln(greatest(abs(sum(c2)) / 2, 1) / greatest(abs(sum(c1)) / 2, 1)) AS divergence FROM nx GROUP BY tp, pt1, pt2, side),
  me1 AS (SELECT DISTINCT tp, pt FROM bo)
  SELECT p.tp, pt1, pt2, coalesce(max(n) FILTER (side = 1), 0)::INTEGER AS n_forward, coalesce(max(n) FILTER (side = 2), 0)::INTEGER AS n_backward, {r('avg(divergence) AS divergence', 'avg(turn) AS turn')}
  FROM pa p WHERE (p.tp, pt1) IN (SELECT (tp, pt) FROM me1) AND (p.tp + 1, pt2) IN (SELECT (tp, pt) FROM me1) GROUP BY p.tp, pt1, pt2""")
def polygon_delta(spark, sf_dir):
    return polygons.polygon_delta(*_graph(spark, sf_dir)).drop("ring")


@query("regular_tracks")
def regular_tracks(spark, sf_dir):
    return splines.regular_tracks(T.track_points(spark, sf_dir), 240.0)


@query("soft_pairs")
def soft_pairs(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    return softassign.soft_pairs(points, points.withColumn("tp", F.col("tp") - 1), RADIUS)


@query("linked_by", f"""WITH RECURSIVE {FRAMES}, pr AS (SELECT a.tp, a.pt AS pt1, b.pt AS pt2, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM de a JOIN de b ON b.tp = a.tp + 2 AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < {RADIUS}),
  mu AS (SELECT tp, pt1, pt2 FROM pr QUALIFY row_number() OVER (PARTITION BY tp, pt1 ORDER BY dist, pt2) = 1 AND row_number() OVER (PARTITION BY tp, pt2 ORDER BY dist, pt1) = 1), bk AS (SELECT tp + 2 AS tp, pt2 AS pt, pt1 FROM mu),
  ch AS (SELECT tp, pt, tp AS root_tp, pt AS root_pt, 0 AS depth FROM de WHERE (tp, pt) NOT IN (SELECT (tp, pt) FROM bk) UNION ALL SELECT bk.tp, bk.pt, ch.root_tp, ch.root_pt, ch.depth + 1 FROM ch JOIN bk ON bk.tp = ch.tp + 2 AND bk.pt1 = ch.pt) SELECT * FROM ch""")
def linked_by(spark, sf_dir):
    return links.linked_by(T.detections(spark, sf_dir), "Mutual", RADIUS, 2)


@query("inner_peaks", f"""WITH {PIXELS}, im AS (SELECT image, max("row") + 1 AS rows, max(col) + 1 AS cols FROM px GROUP BY image)
  SELECT a.image, {r('a.col / cols AS x', '1 - a."row" / rows AS y', 'a.value AS score')} FROM px a JOIN im ON im.image = a.image WHERE a.value > 20 AND a."row" BETWEEN 2 AND rows - 3 AND a.col BETWEEN 2 AND cols - 3
  AND NOT EXISTS (SELECT 1 FROM px b WHERE b.image = a.image AND abs(b."row" - a."row") <= 2 AND abs(b.col - a.col) <= 2 AND (b.value > a.value OR (b.value = a.value AND (b."row", b.col) < (a."row", a.col))))""")
def inner_peaks(spark, sf_dir):
    px, images, _ = _marked(spark, sf_dir)
    return pixels.inner_peaks(px, images, 2, 20)


@query("pixel_rescaled", f"""WITH {PIXELS}, bl AS (SELECT image, "row" // 3 AS "row", col // 3 AS col, sum(value) / 9 AS v FROM px GROUP BY ALL), m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM bl WINDOW w AS (PARTITION BY image))
  SELECT image, "row"::INTEGER AS "row", col::INTEGER AS col, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS value FROM m""", 6)
def pixel_rescaled(spark, sf_dir):
    return pixels.rescaled(T.pixels(spark, sf_dir), 3)
