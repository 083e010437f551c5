"""Registered queries of series over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import groups, lookups, mesh, reports, series, timelines, tracks
from fieldtrace.plans.catalogue import FRAMES, POINTS, query, r
from fieldtrace.plans.meshes import NEAR, RIM, _graph
from fieldtrace.sources import tables as T

WEIGHTS = "(SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k))"


@query("colony_areas", f"""WITH {RIM}, an AS (SELECT *, atan2(y - avg(y) OVER f, x - avg(x) OVER f) AS a, count(*) OVER f AS n FROM ri WINDOW f AS (PARTITION BY tp)),
  ed AS (SELECT tp, n, x * coalesce(lead(y) OVER w, first(y) OVER w) - y * coalesce(lead(x) OVER w, first(x) OVER w) AS c FROM an WINDOW w AS (PARTITION BY tp ORDER BY a, pt)),
  ar AS (SELECT row_number() OVER (ORDER BY tp) - 1 AS place, count(*) OVER () AS m, tp, area FROM (SELECT tp, abs(sum(c)) / 2 AS area FROM ed GROUP BY tp)),
  mi AS (SELECT place, tp, area, m, w, ((place + k) % (2 * m) + 2 * m) % (2 * m) AS q FROM ar, {WEIGHTS}),
  sm AS (SELECT mi.place, mi.tp, any_value(mi.area) AS area, sum(w * b.area) AS smooth FROM mi JOIN ar b ON b.place = CASE WHEN q < mi.m THEN q ELSE 2 * mi.m - 1 - q END GROUP BY mi.place, mi.tp)
  SELECT place::INTEGER AS place, tp, {r('area', 'smooth', '(smooth - lag(smooth) OVER w) / first(smooth) OVER w AS change', decimals=3)} FROM sm WINDOW w AS (ORDER BY place)""", 3)
def colony_areas(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    rim = mesh.sector_rim(points, 12)
    centre = rim.groupBy("tp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    outline = rim.join(centre, "tp").select("tp", F.struct(F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx")).alias("a"), "pt").alias("place"), "pt")
    return timelines.colony_areas(outline, points)


@query("field_series", f"WITH {FRAMES}, tr AS (SELECT pt % 50 AS track, tp, pt FROM de) SELECT tr.track, tr.tp, tr.pt, {r('d.x AS x', 'e.score AS score')} FROM tr JOIN de d USING (tp, pt) LEFT JOIN (SELECT tp, pt, score FROM de WHERE y > 20) e USING (tp, pt)")
def field_series(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    tracks = points.select((F.col("pt") % 50).alias("track"), "tp", "pt")
    return timelines.field_series(tracks, {"x": points.withColumn("value", F.col("x")), "score": points.filter("y > 20").withColumn("value", F.col("score"))})


@query("smooth_series", f"""WITH {POINTS}, wi AS (SELECT *, regr_slope(x, tp) OVER w AS sx, regr_intercept(x, tp) OVER w AS ix, count(*) OVER w AS k, count(*) OVER v AS n, (count(*) OVER v - 1) / (count(*) OVER v * 2 - 1) AS step FROM tp WINDOW v AS (PARTITION BY track), w AS (PARTITION BY track ORDER BY tp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  ti AS (SELECT track, n, unnest(range(n * 2)) AS place, step FROM (SELECT DISTINCT track, n, step FROM wi) WHERE step > 0), ow AS (SELECT ti.track, place, place * step AS t, n, CASE WHEN place = n * 2 - 1 THEN n - 1 ELSE (SELECT max(p.tp) FROM tp p WHERE p.track = ti.track AND ceil(p.tp / step) <= place) END AS own FROM ti),
  ev AS (SELECT o.track, o.place, o.t, ix + sx * o.t AS x, o.n * 2 AS m FROM ow o JOIN wi ON wi.track = o.track AND wi.k = 5 AND wi.tp = least(greatest(o.own, 2), o.n - 3))
  SELECT a.track, a.place, round(any_value(a.t), 4) AS t, round(avg(b.x), 4) AS x FROM (SELECT track, place, t, m, unnest(range(place - 3, place + 3)) AS k FROM ev) a JOIN ev b ON b.track = a.track AND b.place = greatest(0, least(a.m - 1, a.k)) GROUP BY a.track, a.place""")
def smooth_series(spark, sf_dir):
    return timelines.smooth_series(T.track_points(spark, sf_dir), ["x"], 2, 5, 3)


@query("frames_of_samples", f"WITH {POINTS}, f AS (SELECT track, CAST(floor(t / 1000) AS BIGINT) AS frame, avg(x) AS x FROM tp WHERE y > 50 GROUP BY ALL) SELECT tp.track, tp.tp, tp.tp AS pt, round(f.x, 4) AS x FROM tp LEFT JOIN f ON f.track = tp.track AND f.frame = tp.tp")
def frames_of_samples(spark, sf_dir):
    points = T.track_points(spark, sf_dir)
    return timelines.frames_of_samples(points.withColumn("pt", F.col("tp")), points.filter("y > 50"), 1000, "x")


@query("near_tracks", f"""WITH {NEAR}, h2 AS (SELECT DISTINCT a.tp, a.pt, b.near FROM bo a JOIN bo b ON a.tp = b.tp AND a.near = b.pt WHERE b.near <> a.pt AND (a.tp, a.pt, b.near) NOT IN (SELECT (tp, pt, near) FROM bo))
  SELECT DISTINCT pt % 40 AS track, near % 40 AS near FROM h2 WHERE pt % 40 <> near % 40""")
def near_tracks(spark, sf_dir):
    points, edges, _ = _graph(spark, sf_dir)
    return timelines.near_tracks(points, edges, points.select("tp", "pt", (F.col("pt") % 40).alias("track")), 2)


@query("united_regions", f"WITH {POINTS} SELECT DISTINCT track FROM tp WHERE x BETWEEN 20 AND 25 OR y >= 98")
def united_regions(spark, sf_dir):
    points = T.track_points(spark, sf_dir)
    return timelines.named_union(points.filter("x between 20 and 25").select("track"), points.filter("y >= 98").select("track"))


@query("different_tracks", f"WITH {POINTS} SELECT track, count(*) AS n FROM tp WHERE tp % 9 = 4 OR (track % 2 = 0 AND tp % 7 = 1) GROUP BY track")
def different_tracks(spark, sf_dir):
    points = T.track_points(spark, sf_dir)
    moved = points.filter("tp % 9 <> 4").withColumn("x", F.when((F.col("track") % 2 == 0) & (F.col("tp") % 7 == 1), F.col("x") + 1e-4).otherwise(F.col("x") + 1e-7))
    return timelines.different_tracks(points, moved)


@query("array_tracks", f"WITH {POINTS} SELECT track, tp::INTEGER AS tp, {r('t', 'x', 'y')} FROM tp")
def array_tracks(spark, sf_dir):
    return timelines.tracks_from_arrays(timelines.tracks_to_arrays(T.track_points(spark, sf_dir)))


@query("groups_to_long", 'SELECT \'Returned\' AS "group", l_quantity::DOUBLE AS value FROM lineitem WHERE l_returnflag = \'R\' UNION ALL SELECT \'N\', l_quantity::DOUBLE FROM lineitem WHERE l_returnflag = \'N\'')
def groups_to_long(spark, sf_dir):
    rows = T.read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    return timelines.groups_to_long({k: rows.filter(F.col("l_returnflag") == k) for k in "RN"}, "q", {"R": "Returned"})


@query("shared_names", "SELECT DISTINCT upper(regexp_replace(event_type, '[\\s_.-]+', '', 'g')) AS name FROM events WHERE event_id % 2 = 0 INTERSECT SELECT upper(regexp_replace(event_type, '[\\s_.-]+', '', 'g')) FROM events WHERE event_id % 2 = 1")
def shared_names(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").withColumn("name", F.concat(F.lower("event_type"), F.lit("_")))
    return timelines.shared_names(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1").withColumn("name", F.upper("event_type")), "name")


@query("tile_metadata", "SELECT c_custkey AS file, c_nationkey + 1 AS tile, n_name AS site FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tile_metadata(spark, sf_dir):
    files = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_nationkey") + 1).alias("tile"))
    return timelines.with_tile_metadata(files, T.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("site")))


@query("places_along", f"""WITH {POINTS}, st AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, coalesce(sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)), 0) AS s FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  cu AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY track ORDER BY tp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(s) OVER (PARTITION BY track) * 0.3 AS g FROM st), la AS (SELECT * FROM cu WHERE b <= g QUALIFY row_number() OVER (PARTITION BY track ORDER BY b DESC, tp) = 1)
  SELECT track, {r('CASE WHEN s > 0 THEN x + (x1 - x) * least((g - b) / s, 1) ELSE x END AS x', 'CASE WHEN s > 0 THEN y + (y1 - y) * least((g - b) / s, 1) ELSE y END AS y')} FROM la""")
def places_along(spark, sf_dir):
    return timelines.along(T.track_points(spark, sf_dir), 0.3)


@query("scaled_density", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM events), b AS (SELECT least(floor((value - lo) / ((hi - lo) / 1024)), 1023) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1),
  k AS (SELECT place, lo + place * (hi - lo) / 99 AS "at", sum(n * exp(-power((place * (hi - lo) / 99 - (bin + 0.5) * (hi - lo) / 1024) / 5, 2) / 2) / (5 * sqrt(2 * pi())) / total) AS d FROM b, e, (SELECT unnest(range(100)) AS place) GROUP BY place, lo, hi),
  s AS (SELECT sum(d * (CASE WHEN place = 0 OR place = 98 THEN 1.0 / 3 WHEN place < 98 AND place % 2 = 1 THEN 4.0 / 3 WHEN place < 98 THEN 2.0 / 3 ELSE 0 END + CASE place WHEN 99 THEN 5.0 / 12 WHEN 98 THEN 2.0 / 3 WHEN 97 THEN -1.0 / 12 ELSE 0 END)) * (max("at") - min("at")) / 99 AS area FROM k)
  SELECT place::INTEGER AS place, round("at", 6) AS "at", round(d * 2.5 / area, 6) AS density, coalesce(sign(d - lag(d) OVER w) > sign(lead(d) OVER w - d), FALSE) AS peak FROM k, s WINDOW w AS (ORDER BY place)""", 6)
def scaled_density(spark, sf_dir):
    return timelines.scaled_density(groups.density(T.read(spark, sf_dir, "events"), "value", 5.0), 2.5)


@query("radial_motion", f"""WITH {POINTS}, st AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS s, sqrt(power(x - first(x) OVER w, 2) + power(y - first(y) OVER w, 2)) AS displacement, t - first(t) OVER w AS e FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  di AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY tp) AS distance FROM st) SELECT track, tp, {r('displacement', 'distance', 'CASE WHEN distance > 0 THEN displacement / distance END AS ratio', 'CASE WHEN e > 0 THEN displacement / e END AS velocity', 'CASE WHEN e > 0 THEN distance / e END AS speed')} FROM di""")
def radial_motion(spark, sf_dir):
    return tracks.radial_motion(T.track_points(spark, sf_dir))


@query("axis_velocity", f"""WITH {POINTS}, v AS (SELECT track, tp, count(*) OVER (PARTITION BY track) AS n, lead(t) OVER w - t AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp))
  SELECT track, tp, {r('CASE WHEN n = 1 THEN 0 WHEN dt > 0 THEN dx / dt END AS vx', 'CASE WHEN n = 1 THEN 0 WHEN dt > 0 THEN dy / dt END AS vy', 'CASE WHEN n = 1 THEN 0 WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt END AS v', decimals=6)} FROM v WHERE n = 1 OR dt IS NOT NULL""", 6)
def axis_velocity(spark, sf_dir):
    return tracks.axis_velocity(T.track_points(spark, sf_dir))


@query("filled_tracks", f"""WITH {FRAMES}, tr AS (SELECT pt % 60 AS track, tp, x, y, row_number() OVER (PARTITION BY pt % 60, tp ORDER BY pt) AS k FROM de), jo AS (SELECT CASE WHEN track % 2 = 1 THEN track - 1 ELSE track END AS head, track, tp, x, y FROM tr WHERE k = 1 AND (tp + track) % 4 > 0),
  un AS (SELECT head, tp, min_by(x, track) AS x, min_by(y, track) AS y FROM jo GROUP BY head, tp), nx AS (SELECT *, lead(tp) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM un WINDOW w AS (PARTITION BY head ORDER BY tp)),
  fi AS (SELECT *, unnest(range(tp, coalesce(t1, tp + 1))) AS frame FROM nx) SELECT head AS track, frame, {r('x + coalesce((x1 - x) * (frame - tp) / (t1 - tp), 0) AS x', 'y + coalesce((y1 - y) * (frame - tp) / (t1 - tp), 0) AS y', decimals=6)} FROM fi""", 6)
def filled_tracks(spark, sf_dir):
    rows = T.detections(spark, sf_dir).groupBy((F.col("pt") % 60).alias("track"), "tp").agg(F.min_by(F.struct("x", "y"), "pt").alias("p")).select("track", "tp", "p.x", "p.y").filter((F.col("tp") + F.col("track")) % 4 > 0)
    joins = rows.filter("track % 2 = 1").select("track", (F.col("track") - 1).alias("head")).distinct()
    return series.filled_tracks(rows, joins)


@query("permuted_rows", "WITH u AS (SELECT c_custkey, ('0x' || substr(md5('9/' || c_custkey), 1, 8))::BIGINT / 4294967296 AS u FROM customer) SELECT c_custkey, row_number() OVER (ORDER BY u, c_custkey)::INTEGER - 1 AS place FROM u QUALIFY place < 100")
def permuted_rows(spark, sf_dir):
    return reports.permuted(T.read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "9", 100)


@query("rows_as_json", "SELECT c_custkey, to_json({'c_name': c_name, 'c_nationkey': c_nationkey, 'tags': [c_mktsegment]}) AS json FROM customer")
def rows_as_json(spark, sf_dir):
    rows = T.read(spark, sf_dir, "customer").withColumn("tags", F.array("c_mktsegment"))
    return lookups.as_json(rows, "c_custkey", ["c_name", "c_nationkey", "tags"])
