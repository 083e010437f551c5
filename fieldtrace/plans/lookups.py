"""Queries for lookups, catalogs, reports and pixel windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.functions import geometry
from fieldtrace.operators import lookups, mesh, pixels, reports
from fieldtrace.sources import tables as T

from .catalogue import BOXES, FRAMES, PIXELS, POINTS, query, r, wide

#: Polygon of track points, and what widening it by 1e-5 about its centroid gives.
FIELD = ((20.0, 10.0), (120.0, 5.0), (150.0, 60.0), (70.0, 45.0), (30.0, 80.0))


def _within(vertices, x="x", y="y") -> str:
    terms = [f"CASE WHEN ({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0]} - {a[0]}) * ({y} - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(vertices, vertices[1:] + vertices[:1], strict=True)]
    return f"({' + '.join(terms)}) % 2 = 1"


@query("complete_cases", "SELECT page_id, lang FROM (SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), '') AS lang, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS n FROM pages) WHERE lang IS NOT NULL AND n IS NOT NULL")
def complete_cases(spark, sf_dir):
    url = F.col("url")
    rows = T.read(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract(url, "/([a-z]{2})/[0-9]+", 1), F.lit("")).alias("lang"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("n"))
    return lookups.complete(rows, ["lang", "n"]).drop("n")


@query("field_values", f"WITH {FRAMES} SELECT tp, pt, {r('score')} FROM de WHERE (tp, pt) IN (SELECT tp, pt FROM de WHERE y >= 90)")
def field_values(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    return lookups.values_at(points, points.filter("y >= 90"), "score")


@query("frame_values", f"WITH {FRAMES} SELECT tp, {r('x')} FROM de WHERE tp BETWEEN 5 AND 9")
def frame_values(spark, sf_dir):
    return T.detections(spark, sf_dir).filter("tp between 5 and 9").select("tp", "x")


@query("real_coordinates", f"WITH {POINTS} SELECT track, tp, {r('x * 0.65 AS x', 'y * 0.65 AS y')} FROM tp")
def real_coordinates(spark, sf_dir):
    points = T.track_points(spark, sf_dir).withColumns({"rx": F.col("x") * 0.65, "ry": F.col("y") * 0.65})
    return lookups.coordinates(points, "real").select("track", "tp", "x", "y")


@query("tracks_in_roi", f"WITH {POINTS} SELECT DISTINCT track FROM tp WHERE tp BETWEEN 10 AND 30 AND {_within(wide(FIELD))}")
def tracks_in_roi(spark, sf_dir):
    return lookups.tracks_in(T.track_points(spark, sf_dir), FIELD, 10, 30)


@query("timelines_in_roi", f"WITH {POINTS} SELECT track, tp FROM tp WHERE {_within(wide(FIELD))}")
def timelines_in_roi(spark, sf_dir):
    return lookups.points_in(T.track_points(spark, sf_dir), FIELD).select("track", "tp")


def _track_of(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("tp"), F.col("event_id").alias("pt"), F.col("user_id").alias("track"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


EVENTS = "ev AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tp, event_id AS pt, user_id AS track, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"


@query("point_tracks", f"WITH {EVENTS} SELECT tp, pt, CASE WHEN track % 2 = 0 THEN track END AS track FROM ev")
def point_tracks(spark, sf_dir):
    rows = _track_of(spark, sf_dir)
    return lookups.point_tracks(rows.filter("track % 2 = 0"), rows.select("tp", "pt"))


@query("neighbours_over_time", f"WITH {EVENTS} SELECT DISTINCT a.track, b.track AS near FROM ev a JOIN ev b ON a.tp = b.tp AND a.track <> b.track AND abs(a.x - b.x) <= 2 WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2")
def neighbours_over_time(spark, sf_dir):
    return lookups.tracks_near(_track_of(spark, sf_dir), 2.0)


@query("local_density", f"""WITH {EVENTS}, nb AS (SELECT a.tp, a.pt, b.x, b.y, b.pt AS q FROM ev a JOIN ev b ON a.tp = b.tp AND a.pt <> b.pt AND abs(a.x - b.x) <= 8 WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 8),
  m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n FROM nb WINDOW w AS (PARTITION BY tp, pt)),
  o AS (SELECT *, row_number() OVER (PARTITION BY tp, pt ORDER BY atan2(y - my, x - mx), x, y) AS k FROM m WHERE n >= 3),
  c AS (SELECT a.tp, a.pt, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM o a JOIN o b ON a.tp = b.tp AND a.pt = b.pt AND b.k = a.k % a.n + 1 GROUP BY ALL) SELECT tp, pt, round(1 / greatest(area, 1), 3) AS density FROM c""", 3)
def local_density(spark, sf_dir):
    return mesh.radius_density(_track_of(spark, sf_dir), 8.0).select("tp", "pt", "density")


@query("output_names", """SELECT page_id, 'out/tile' || lpad((page_id % 7)::VARCHAR, 2, '0') || '/' || regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) || '-t' || lpad((page_id % 900)::VARCHAR, 3, '0') || '.tif' AS name FROM pages""")
def output_names(spark, sf_dir):
    parts = {"base": F.lit("out"), "tile": F.col("page_id") % 7, "channel": F.regexp_extract("url", "/([a-z]{2})/[0-9]+", 1), "timepoint": F.col("page_id") % 900, "ext": F.lit("tif")}
    return T.read(spark, sf_dir, "pages").select("page_id", lookups.named(parts).alias("name"))


@query("canonical_channels", "SELECT c_custkey, CASE upper(c_mktsegment) WHEN 'FURNITURE' THEN 'HOME' WHEN 'HOUSEHOLD' THEN 'HOME' ELSE upper(c_mktsegment) END AS channel FROM (SELECT c_custkey, regexp_replace(c_mktsegment, '[ _.-]+', '', 'g') AS c_mktsegment FROM customer)")
def canonical_channels(spark, sf_dir):
    return lookups.canonical(T.read(spark, sf_dir, "customer"), "c_mktsegment", {"FURNITURE": "HOME", "HOUSEHOLD": "HOME"}).select("c_custkey", "channel")


@query("detector_specs", "SELECT p_partkey, 'net' || (p_size % 3) AS detector, p_size % 9 AS run, (p_partkey % 50) * CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 1000000 END AS iterations FROM part")
def detector_specs(spark, sf_dir):
    rows = T.read(spark, sf_dir, "part").select("p_partkey", F.format_string("net%d-r%d-%d%s", F.col("p_size") % 3, F.col("p_size") % 9, F.col("p_partkey") % 50, F.when(F.col("p_partkey") % 2 == 0, "k").otherwise("M")).alias("spec"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in lookups.detector_spec(F.col("spec")).items()])


FILES = "fi AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang, coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT), 0) AS tp FROM pages)"


def _files(spark, sf_dir):
    url = F.col("url")
    return T.read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract(url, "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract(url, "/([a-z]{2})/[0-9]+", 1).alias("lang"), F.coalesce(F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)"), F.lit(0)).alias("tp"))


@query("file_groups", f"WITH {FILES} SELECT host, lang, count(*) AS n, arg_min(url, (tp, url)) AS first, arg_max(url, (tp, url)) AS last FROM fi GROUP BY host, lang")
def file_groups(spark, sf_dir):
    return lookups.file_groups(_files(spark, sf_dir), ["host", "lang"], "tp", "url")


@query("duplicate_files", f"WITH {FILES} SELECT host, lang, tp, count(*) AS n FROM fi GROUP BY ALL HAVING count(*) > 1")
def duplicate_files(spark, sf_dir):
    return lookups.duplicates(_files(spark, sf_dir), ["host", "lang", "tp"])


@query("complete_tiles", f"WITH {FILES} SELECT host FROM fi GROUP BY host HAVING count(DISTINCT lang) = 4")
def complete_tiles(spark, sf_dir):
    return lookups.complete_tiles(_files(spark, sf_dir), "host", "lang", 4)


@query("first_files", f"WITH {FILES} SELECT host, min(url) AS found FROM fi WHERE starts_with(url, 'http://' || host || '/e') GROUP BY host")
def first_files(spark, sf_dir):
    return lookups.first_by_prefix(_files(spark, sf_dir), "host", "url", F.concat(F.lit("http://"), F.col("host"), F.lit("/e")))


@query("unpaired_files", f"WITH {FILES} SELECT page_id FROM fi a WHERE NOT EXISTS (SELECT 1 FROM fi b WHERE b.host = a.host AND b.tp = a.tp AND b.lang = 'en')")
def unpaired_files(spark, sf_dir):
    files = _files(spark, sf_dir)
    return lookups.unpaired(files, files.filter("lang = 'en'"), ["host", "tp"]).select("page_id")


@query("detector_groups", f"WITH {EVENTS}, k AS (SELECT tp, track, event_type FROM ev JOIN events ON event_id = pt) SELECT tp, track, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS detectors, count(*) AS n FROM k GROUP BY tp, track HAVING count(DISTINCT event_type) >= 2")
def detector_groups(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return lookups.detector_groups(T.read(spark, sf_dir, "events").select(day.alias("tp"), F.col("user_id").alias("track"), "event_type"), ["tp", "track"], "event_type", 2)


@query("replica_links", f"WITH {EVENTS}, f AS (SELECT tp, track, min(pt) AS reference FROM ev GROUP BY tp, track) SELECT tp, track, reference, pt FROM ev JOIN f USING (tp, track) WHERE pt <> reference")
def replica_links(spark, sf_dir):
    return lookups.replica_links(_track_of(spark, sf_dir).withColumn("place", F.col("pt")), ["tp", "track"], "place", "pt")


@query("parsed_boxes", f"WITH {BOXES} SELECT file, sel_class, [x0, y0, x1, y1][1]::INTEGER AS a, y0::INTEGER AS b, x1::INTEGER AS c, y1::INTEGER AS d FROM bn UNION ALL SELECT -1, 'none', 0, 0, -1, -1")
def parsed_boxes(spark, sf_dir):
    from fieldtrace.operators import annotations

    b = annotations.deduplicated(T.annotations(spark, sf_dir))
    text = F.concat_ws("x", *[F.col(c).cast("int").cast("string") for c in ("x0", "y0", "x1", "y1")])
    rows = b.select("file", "sel_class", text.alias("text")).union(b.sparkSession.createDataFrame([(-1, "none", None)], "file long, sel_class string, text string"))
    return rows.select("file", "sel_class", *[lookups.parsed_box(F.col("text"))[i].alias(c) for i, c in enumerate("abcd")])


@query("box_axes", f"WITH {BOXES} SELECT file, sel_class, {r('sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) / 2 AS major', 'sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) / 2 AS minor', '(x1 - x0) * (y1 - y0) * 4 AS doubled')} FROM bn")
def box_axes(spark, sf_dir):
    from fieldtrace.operators import annotations

    v = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    b = annotations.deduplicated(T.annotations(spark, sf_dir)).withColumn("v", v).withColumn("a", geometry.axes(F.col("v")))
    return b.select("file", "sel_class", F.col("a.major").alias("major"), F.col("a.minor").alias("minor"), geometry.area(geometry.scale(F.col("v"), 2.0)).alias("doubled"))


LINES = "SELECT l_returnflag AS cond, CAST(l_quantity AS INTEGER) AS q, l_extendedprice * 0.3712345678 AS v FROM lineitem"


def _lines(spark, sf_dir):
    return T.read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cond"), F.col("l_quantity").cast("int").alias("q"), (F.col("l_extendedprice") * 0.3712345678).alias("v"))


@query("std_envelope", f"SELECT cond, q, count(v) AS n, {r('avg(v) AS centre', 'CASE WHEN count(v) > 1 THEN avg(v) - stddev_pop(v) END AS low', 'CASE WHEN count(v) > 1 THEN avg(v) + stddev_pop(v) END AS high', decimals=2)} FROM ({LINES}) GROUP BY cond, q", 2)
def std_envelope(spark, sf_dir):
    return reports.envelope(_lines(spark, sf_dir), ["cond", "q"], "v", "std")


@query("iqr_envelope", f"SELECT cond, q, count(v) AS n, {r('quantile_cont(v, 0.5) AS centre', 'CASE WHEN count(v) > 1 THEN quantile_cont(v, 0.25) END AS low', 'CASE WHEN count(v) > 1 THEN quantile_cont(v, 0.75) END AS high', decimals=2)} FROM ({LINES}) GROUP BY cond, q", 2)
def iqr_envelope(spark, sf_dir):
    return reports.envelope(_lines(spark, sf_dir), ["cond", "q"], "v", "iqr")


@query("line_summary", f"WITH s AS (SELECT q AS x, cond AS hue, avg(v * 0.37) AS mean, count(*) AS n FROM ({LINES}) GROUP BY ALL) SELECT x, hue, round(mean, 3) AS mean, n FROM s UNION ALL SELECT -x, hue, round(mean, 3), n FROM s WHERE x <> 0", 3)
def line_summary(spark, sf_dir):
    return reports.line_summary(_lines(spark, sf_dir), "q", "cond", "v", 0.37, mirror=True)


def _members(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select(F.col("user_id").alias("track")).distinct().withColumn("bin", F.col("track") % 3)


@query("compartment_stats", f"WITH {EVENTS}, n AS (SELECT tp, count(x) AS total FROM ev GROUP BY tp), e2 AS (SELECT tp, track, x * 0.3712345678 AS x FROM ev) SELECT tp, track % 3 AS bin, {r('avg(x) AS mean', 'stddev_pop(x) AS std', 'quantile_cont(x, 0.25) AS p25', 'quantile_cont(x, 0.5) AS p50', 'quantile_cont(x, 0.75) AS p75', decimals=3)}, count(x) AS n, round(count(x) / any_value(total), 3) AS support FROM e2 JOIN n USING (tp) GROUP BY tp, track % 3", 3)
def compartment_stats(spark, sf_dir):
    return reports.compartment_stats(_members(spark, sf_dir), _track_of(spark, sf_dir).withColumn("x", F.col("x") * 0.3712345678), "track", "tp", "x")


@query("compartment_shares", f"WITH {EVENTS}, c AS (SELECT track % 3 AS bin, CAST(floor(x / 25) AS BIGINT) AS stretch, count(*) AS n FROM ev GROUP BY ALL) SELECT bin, stretch, round(n / sum(n) OVER (PARTITION BY bin), 4) AS share FROM c")
def compartment_shares(spark, sf_dir):
    return reports.compartment_shares(_members(spark, sf_dir), _track_of(spark, sf_dir), "track", "x", 25)


@query("mean_tracks", f"WITH {POINTS}, h AS (SELECT DISTINCT track, track - track % 2 AS head FROM tp), z AS (SELECT head, count(*) AS size FROM h GROUP BY head) SELECT head, tp, {r('avg(x) AS x', 'avg(y) AS y', decimals=3)} FROM tp JOIN h USING (track) JOIN z USING (head) GROUP BY head, tp HAVING count(*) = any_value(size)", 3)
def mean_tracks(spark, sf_dir):
    points = T.track_points(spark, sf_dir)
    return reports.merged_mean(points, points.select("track", (F.col("track") - F.col("track") % 2).alias("head")).distinct())


@query("percentile_limits", f"SELECT cond, {r('quantile_cont(v, 0.01) AS low', 'quantile_cont(v, 0.99) AS high', decimals=2)} FROM ({LINES}) GROUP BY cond", 2)
def percentile_limits(spark, sf_dir):
    return reports.percentile_limits(_lines(spark, sf_dir), "cond", "v")


def _u(*parts: str) -> str:
    text = " || '/' || ".join(p if p.startswith("(") else f"'{p}'" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("crop_parameters", f"""WITH d AS (SELECT p_partkey, CAST(draw AS INTEGER) AS draw FROM part, (SELECT unnest(range(3)) AS draw)), s AS (SELECT *, CAST(16 + floor({_u('crop', '(p_partkey)', '(draw)', 'size')} * 33) AS INTEGER) AS size FROM d)
  SELECT p_partkey, draw, size, round({_u('crop', '(p_partkey)', '(draw)', 'angle')} * 360, 4) AS angle, {_u('crop', '(p_partkey)', '(draw)', 'flip_x')} < 0.5 AS flip_x, {_u('crop', '(p_partkey)', '(draw)', 'flip_y')} < 0.5 AS flip_y,
  CAST(floor({_u('crop', '(p_partkey)', '(draw)', 'x0')} * (640 - size + 1)) AS INTEGER) AS x0, CAST(floor({_u('crop', '(p_partkey)', '(draw)', 'y0')} * (480 - size + 1)) AS INTEGER) AS y0 FROM s""")
def crop_parameters(spark, sf_dir):
    return reports.crops(T.read(spark, sf_dir, "part"), "p_partkey", "crop", 3, 640, 480, 16, 48)


@query("drawn_rows", f"WITH n AS (SELECT count(*) AS n FROM customer), d AS (SELECT CAST(floor({_u('draw', '(k)')} * n) AS BIGINT) AS c_custkey FROM n, (SELECT unnest(range(500)) AS k)) SELECT c_custkey, count(*) AS times FROM d JOIN customer USING (c_custkey) GROUP BY c_custkey")
def drawn_rows(spark, sf_dir):
    return reports.drawn(T.read(spark, sf_dir, "customer"), "c_custkey", "draw", 500)


PARAMETERS = POINTS + """, ce AS (SELECT round(avg(x), 6) AS mx, round(avg(y), 6) AS my FROM tp), st AS (SELECT *, sqrt(power(x - mx, 2) + power(y - my, 2)) AS radius, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM tp, ce WINDOW w AS (PARTITION BY track ORDER BY tp)),
  g AS (SELECT track, avg(radius) AS radius, max(t) AS "time", sum(step) AS distance, sqrt(power(max_by(x, tp) - min_by(x, tp), 2) + power(max_by(y, tp) - min_by(y, tp), 2)) AS displacement, max_by(t, tp) - min_by(t, tp) AS duration FROM st GROUP BY track),
  pa AS (SELECT track, radius, "time", distance, displacement, CASE WHEN duration > 0 THEN displacement / duration END AS velocity, CASE WHEN duration > 0 THEN distance / duration END AS speed, CASE WHEN distance > 0 THEN displacement / distance END AS straightness FROM g)"""


@query("track_parameters", f"WITH {PARAMETERS} SELECT track, {r('radius', 'distance', 'displacement', 'velocity', 'speed', 'straightness', decimals=3)}, round(\"time\", 3) AS \"time\" FROM pa", 3)
def track_parameters(spark, sf_dir):
    return reports.parameters(T.track_points(spark, sf_dir))


NAMES = ["distance", "displacement", "speed", "straightness"]
RINGS = (0.0, 40.0, 50.0, 1000.0)


@query("radial_report", f"""WITH {PARAMETERS}, bi AS (SELECT *, CASE WHEN radius < 40 THEN 'a' WHEN radius < 50 THEN 'b' ELSE 'c' END AS bin FROM pa), lo AS ({' UNION ALL '.join(f"SELECT bin, '{n}' AS name, {n} AS v FROM bi" for n in NAMES)}),
  ow AS (SELECT name, bin, count(v) AS n, avg(v) AS m, var_samp(v) AS s FROM lo GROUP BY name, bin HAVING count(v) > 1)
  SELECT a.name, a.bin AS bin1, b.bin AS bin2, {r('(a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS statistic', 'power(a.s / a.n + b.s / b.n, 2) / (power(a.s / a.n, 2) / (a.n - 1) + power(b.s / b.n, 2) / (b.n - 1)) AS df', decimals=3)} FROM ow a JOIN ow b ON a.name = b.name AND a.bin < b.bin WHERE a.s / a.n + b.s / b.n > 0""", 3)
def radial_report(spark, sf_dir):
    rows = reports.parameters(T.track_points(spark, sf_dir))
    ring = F.when(F.col("radius") < RINGS[1], "a").when(F.col("radius") < RINGS[2], "b").otherwise("c")
    return reports.welch_by_bin(rows.withColumn("bin", ring), "bin", NAMES)


def _rois(spark, sf_dir):
    image = T.pixels(spark, sf_dir).select("image").distinct()
    v = geometry.polygon((1.5, 1.5), (7.5, 0.5), (8.5, 6.5), (3.5, 8.5))
    return image.select(F.concat(F.lit("r"), "image").alias("roi"), "image", F.lit(1.5).alias("x0"), F.lit(0.5).alias("y0"), F.lit(8.5).alias("x1"), F.lit(8.5).alias("y1"), v.alias("v"))


ROI = ((1.5, 1.5), (7.5, 0.5), (8.5, 6.5), (3.5, 8.5))


@query("roi_values", f"""WITH {PIXELS}, i AS (SELECT DISTINCT image FROM px) SELECT 'r' || image AS roi, image, round(avg(value), 4) AS value, count(value) AS n FROM i LEFT JOIN (SELECT * FROM px WHERE {_within(ROI, 'col', '"row"')}) USING (image) GROUP BY image""")
def roi_values(spark, sf_dir):
    return pixels.roi_values(T.pixels(spark, sf_dir), _rois(spark, sf_dir))


@query("polygon_mask", f"""WITH {PIXELS}, g AS (SELECT image, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col FROM (SELECT DISTINCT image FROM px), (SELECT unnest(range(10)) AS a), (SELECT unnest(range(10)) AS b)) SELECT image, "row", col, ({_within(ROI, 'col', '"row"')}) OR ({_within(((0.5, 7.5), (2.5, 7.5), (2.5, 9.5)), 'col', '"row"')}) AS marked FROM g""")
def polygon_mask(spark, sf_dir):
    return pixels.polygon_mask(T.pixels(spark, sf_dir).select("image").distinct(), 10, 10, [ROI, ((0.5, 7.5), (2.5, 7.5), (2.5, 9.5))])


WINDOWS = PIXELS + """, pa AS (SELECT a.image, a."row", a.col, count(*) AS n, avg(b.value) AS mean, avg(CASE WHEN b.value > 25 THEN 1.0 ELSE 0.0 END) AS marked FROM px a JOIN px b ON b.image = a.image AND b."row" BETWEEN a."row" AND a."row" + 2 AND b.col BETWEEN a.col AND a.col + 2 GROUP BY ALL HAVING count(*) = 9)"""


@query("pixel_patches", f'WITH {WINDOWS} SELECT image, "row", col, n, round(mean, 4) AS mean FROM pa')
def pixel_patches(spark, sf_dir):
    return pixels.patches(T.pixels(spark, sf_dir), 3)


@query("patch_labels", f'WITH {WINDOWS} SELECT image, "row", col, round(marked, 4) AS marked, marked >= 0.5 AS label FROM pa')
def patch_labels(spark, sf_dir):
    return pixels.patch_labels(T.pixels(spark, sf_dir), 3, 25, 0.5)


@query("padded_images", f'WITH {PIXELS}, g AS (SELECT image, CAST(a AS INTEGER) AS "row", CAST(b AS INTEGER) AS col FROM (SELECT DISTINCT image FROM px), (SELECT unnest(range(14)) AS a), (SELECT unnest(range(14)) AS b)) SELECT g.image, g."row", g.col, coalesce(value, 0) AS value FROM g LEFT JOIN px ON px.image = g.image AND px."row" = g."row" - 2 AND px.col = g.col - 2')
def padded_images(spark, sf_dir):
    return pixels.padded(T.pixels(spark, sf_dir), 10, 10, 2)


@query("cropped_images", f'WITH {PIXELS} SELECT image, CAST(col - 1 AS INTEGER) AS "row", CAST("row" - 2 AS INTEGER) AS col, value FROM px WHERE "row" >= 2 AND "row" < 9 AND col >= 1 AND col < 8')
def cropped_images(spark, sf_dir):
    return pixels.transposed(pixels.cropped(T.pixels(spark, sf_dir), 10, 10, 2, -1, 1, -2))


@query("noisy_images", f"""WITH {PIXELS} SELECT image, "row", col, CASE WHEN {_u('salt', 'where', '(image)', '("row")', '(col)')} < 0.1 THEN CASE WHEN {_u('salt', 'what', '(image)', '("row")', '(col)')} < 0.5 THEN 0.0 ELSE 1.0 END ELSE value END AS value FROM px""")
def noisy_images(spark, sf_dir):
    return pixels.noisy(T.pixels(spark, sf_dir), "salt", 0.1)


#: One name in each form, and one in none, for every part; what the fields must be follows from the key.
@query("parsed_names", """WITH p AS (SELECT p_partkey, (p_partkey % 6)::INTEGER AS f, (p_partkey % 31)::INTEGER AS s, (p_partkey % 457)::INTEGER AS t, (p_partkey % 5)::INTEGER AS c FROM part)
  SELECT p_partkey, CASE WHEN f < 5 THEN s END AS tile, CASE WHEN f < 5 THEN t END AS timepoint, CASE WHEN f < 5 THEN 0 END AS slice, CASE WHEN f = 0 THEN c WHEN f < 5 THEN 0 END AS multi_tile,
  CASE f WHEN 0 THEN 2 WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN 1 WHEN 4 THEN 1 END AS channel,
  CASE f WHEN 0 THEN 'MCHERRY' WHEN 1 THEN 'Red' WHEN 2 THEN CASE c WHEN 0 THEN '0' WHEN 1 THEN 'TL Brightfield' WHEN 2 THEN 'mCherry' WHEN 3 THEN 'EGFP' ELSE 'mKate' END WHEN 3 THEN 'TL Brightfield' WHEN 4 THEN 'other dye' END AS channel_name FROM p""")
def parsed_names(spark, sf_dir):
    s, t, c = (F.col("p_partkey") % m for m in (31, 457, 5))
    forms = [
        F.format_string("MCHERRY-s%dt%dm%d.tif", s, t, c), F.format_string("2020-01 A.b_s%02dt%03dRed_%d_ORG.tif.gz", s, t, c), F.format_string("run-1-%d_s%dc%d_ORG.TIF", t, s, c),
        F.format_string("run 2_s%dt%d.png", s, t), F.format_string("other dye-s%dt%03d_resp.png", s, t), F.format_string("notes %d", s),
    ]
    rows = T.read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int")).alias("name"))
    return rows.select("p_partkey", *[v.alias(k) for k, v in lookups.parsed_name(F.col("name")).items() if k != "key"])


@query("detector_thresholds", "SELECT event_id, event_type, round(value, 4) AS value, threshold, weight FROM events JOIN (VALUES ('click', 20.0::DOUBLE, 1.0::DOUBLE), ('view', 50.0, 2.0), ('purchase', 5.0, 0.5)) AS t(kind, threshold, weight) ON kind = lower(event_type) WHERE value >= threshold")
def detector_thresholds(spark, sf_dir):
    table = spark.createDataFrame([("Click", 20.0, 1.0), ("VIEW", 50.0, 2.0), ("purchase", 5.0, 0.5)], "event_type string, threshold double, weight double")
    return lookups.above_thresholds(T.read(spark, sf_dir, "events").select("event_id", "event_type", "value"), table, "event_type", "value")


@query("line_bands")
def line_bands(spark, sf_dir):
    return reports.line_bands(_lines(spark, sf_dir), "q", "cond", "v", "9")
