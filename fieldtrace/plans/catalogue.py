"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions import geometry
from fieldtrace.operators import annotations, groups, linking, lookups, persistence, pixels, series, spatial, tracks
from fieldtrace.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RADIUS, HEX = 4.0, ((-0.2, -0.1), (0.0, -0.25), (0.25, -0.1), (0.2, 0.15), (0.0, 0.05), (-0.1, 0.2))

POINTS = """tp AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tp,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 6e7 AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"""
STEPS = POINTS + """, st AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  geo AS (SELECT track, count(*) AS n, sum(step) AS distance, sqrt(power(max_by(x, tp) - min_by(x, tp), 2) + power(max_by(y, tp) - min_by(y, tp), 2)) AS displacement,
  min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM st GROUP BY track)"""
NEXT = POINTS + """, nx AS (SELECT *, lead(t) OVER w - t AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  ve AS (SELECT *, CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt END AS speed FROM nx WHERE dt IS NOT NULL)"""
FRAMES = """d AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tp, event_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, value / 500 AS score FROM events),
  de AS (SELECT tp, event_id AS pt, x, y, score FROM d)"""
PAIRS = FRAMES + f""", pr AS (SELECT a.tp, a.pt AS pt1, b.pt AS pt2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist
  FROM de a JOIN de b ON b.tp = a.tp + 1 AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < {RADIUS}),
  cl AS (SELECT tp, pt2, pt1, dist FROM pr QUALIFY row_number() OVER (PARTITION BY tp, pt2 ORDER BY dist, pt1) = 1),
  ne AS (SELECT tp, pt1, pt2, dist FROM cl QUALIFY row_number() OVER (PARTITION BY tp, pt1 ORDER BY dist, pt2) = 1)"""
LEVELS = """ob AS (SELECT o_orderpriority AS cond, l_extendedprice AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  lv AS (SELECT cond, count(*) AS n, avg(score) AS m, var_samp(score) AS v, stddev_pop(score) AS s FROM ob GROUP BY cond)"""
TRUTH = """tr AS (SELECT quality AS truth, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
  g AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS q FROM tr GROUP BY score),
  cu AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
BOXES = """bx AS (SELECT user_id AS file, event_type AS sel_class, floor(value) AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b, floor(value / 10) AS c, 50.0::DOUBLE AS e FROM events),
  bn AS (SELECT DISTINCT file, sel_class, least(a, c) AS x0, least(b, e) AS y0, greatest(a, c) AS x1, greatest(b, e) AS y1 FROM bx WHERE a <> c AND b <> e)"""
PIXELS = """px AS (SELECT 'I' || (p_partkey // 100) AS image, CAST((p_partkey // 10) % 10 AS INTEGER) AS "row", CAST(p_partkey % 10 AS INTEGER) AS col, CAST(p_size AS DOUBLE) AS value FROM part)"""


def rounded(c: str, decimals: int) -> Column:
    """A double rounded as the SQL's ``round``: its product with the power of ten is, half away from zero, so that a product that is just a half goes up."""
    scale = 10.0**decimals
    shifted = F.col(c) * scale
    return F.when(F.abs(shifted) < float("inf"), F.round(shifted) / scale).otherwise(F.col(c))


def query(name: str, sql: str | None = None, decimals: int = 4):
    """Registers a query; its doubles are rounded, as in the SQL by macro-like ``{c:r}`` marks."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[rounded(c, decimals).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def r(*columns: str, decimals: int = 4) -> str:
    """SQL: each column, or "expression AS name", rounded."""
    return ", ".join(f"round({c.rpartition(' AS ')[0] or c}, {decimals}) AS {c.rpartition(' AS ')[2]}" for c in columns)


GEO = f"track, n, {r('distance', 'displacement', 'x_min', 'x_max', 'y_min', 'y_max', 'CASE WHEN distance > 0 THEN displacement / distance END AS straightness')}"


@query("track_geometry", f"WITH {STEPS} SELECT {GEO} FROM geo")
def track_geometry(spark, sf_dir):
    return tracks.geometry(T.track_points(spark, sf_dir))


@query("track_quality", f"WITH {STEPS} SELECT {GEO} FROM geo WHERE n >= 5 AND distance >= 1 AND displacement >= 1")
def track_quality(spark, sf_dir):
    return tracks.quality(T.track_points(spark, sf_dir))


@query("tracks_in_box", f"WITH {STEPS} SELECT {GEO} FROM geo WHERE x_max >= 200 AND x_min <= 260 AND y_max >= 10 AND y_min <= 20")
def tracks_in_box(spark, sf_dir):
    return tracks.in_box(T.track_points(spark, sf_dir), 200, 10, 260, 20)


@query("track_velocity", f"WITH {NEXT} SELECT track, tp, {r('dt', 'dx', 'dy', 'speed', 'atan2(dy, dx) AS heading')} FROM ve")
def track_velocity(spark, sf_dir):
    return tracks.velocity(T.track_points(spark, sf_dir))


@query("track_motion", f"""WITH {STEPS}, m AS (SELECT track, tp, sqrt(power(x - first(x) OVER w, 2) + power(y - first(y) OVER w, 2)) AS displacement, sum(step) OVER w AS distance FROM st
  WINDOW w AS (PARTITION BY track ORDER BY tp ROWS UNBOUNDED PRECEDING)) SELECT track, tp, {r('displacement', 'distance', 'CASE WHEN distance > 0 THEN displacement / distance END AS ratio')} FROM m""")
def track_motion(spark, sf_dir):
    return tracks.motion(T.track_points(spark, sf_dir))


@query("track_summary", f"""WITH {POINTS} SELECT track, {r('avg(x) AS x_mean', 'stddev_pop(x) AS x_std', 'median(x) AS x_median', 'min(x) AS x_min', 'max(x) AS x_max', decimals=4)}, count(x) AS x_count,
  {r('avg(abs(x)) AS x_absmean', 'median(abs(x)) AS x_absmedian')} FROM tp GROUP BY track""")
def track_summary(spark, sf_dir):
    return tracks.summary(T.track_points(spark, sf_dir), "x")


@query("longest_tracks", f"WITH {NEXT} SELECT track, count(*) AS n FROM tp WHERE track NOT IN (SELECT track FROM ve WHERE speed > 500) GROUP BY track ORDER BY n DESC, track LIMIT 20")
def longest_tracks(spark, sf_dir):
    return tracks.longest(T.track_points(spark, sf_dir), 20, 500)


@query("time_range", f"WITH {POINTS} SELECT track, tp, {r('x', 'y')} FROM tp WHERE tp >= 3 AND tp <= 12")
def time_range(spark, sf_dir):
    return tracks.time_range(T.track_points(spark, sf_dir), 3, 12).select("track", "tp", "x", "y")


@query("rolling_mean", f"""WITH {POINTS}, w AS (SELECT a.track, a.tp, avg(b.x) AS x_mean FROM (SELECT track, tp, unnest(range(tp - 2, tp + 3)) AS k, max(tp) OVER (PARTITION BY track) AS last FROM tp) a
  JOIN tp b ON b.track = a.track AND b.tp = greatest(0, least(a.last, a.k)) GROUP BY 1, 2) SELECT track, tp, {r('x_mean')} FROM w""")
def rolling_mean(spark, sf_dir):
    return tracks.rolling_mean(T.track_points(spark, sf_dir), 5, "x")


SLOPES = POINTS + """, sl AS (SELECT track, tp, regr_slope(x, CAST(tp AS DOUBLE)) OVER w AS slope, count(*) OVER w AS k FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"""


FITS = POINTS + """, wi AS (SELECT *, regr_slope(x, tp) OVER w AS slope, regr_intercept(x, tp) OVER w AS intercept, count(*) OVER w AS k, count(*) OVER (PARTITION BY track) AS n FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  sl AS (SELECT a.track, a.tp, b.slope, b.intercept FROM wi a JOIN wi b ON b.track = a.track AND b.tp = least(greatest(a.tp, 3), a.n - 4) AND b.k = 7)"""
#: Flat places, then without short runs, then with short holes filled unless all are gone; runs of what is left.
FLAT = FITS + """, f0 AS (SELECT track, tp, abs(slope) < 8 AS flat, min(CASE WHEN abs(slope) < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY track) AS whole FROM sl),
  r0 AS (SELECT *, tp - row_number() OVER (PARTITION BY track, flat ORDER BY tp) AS run FROM f0),
  f1 AS (SELECT track, tp, whole, CASE WHEN flat AND whole = 0 AND count(*) OVER (PARTITION BY track, flat, run) < 3 THEN FALSE ELSE flat END AS flat FROM r0),
  r1 AS (SELECT *, tp - row_number() OVER (PARTITION BY track, flat ORDER BY tp) AS run FROM f1),
  f2 AS (SELECT track, tp, CASE WHEN NOT flat AND max(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY track) = 1 AND count(*) OVER (PARTITION BY track, flat, run) < 3 THEN TRUE ELSE flat END AS flat FROM r1),
  r2 AS (SELECT *, tp - row_number() OVER (PARTITION BY track, flat ORDER BY tp) AS run FROM f2),
  fr AS (SELECT track, min(tp) AS start, max(tp) AS stop, count(*) AS n FROM r2 WHERE flat GROUP BY track, run)"""


def flat_stretches(spark, sf_dir):
    return persistence.flat_runs(persistence.rolling_fit(T.track_points(spark, sf_dir), 7, "tp", "x"), 8, 3)


@query("rolling_slope", f"WITH {FITS} SELECT track, tp, {r('slope')} FROM sl")
def rolling_slope(spark, sf_dir):
    return persistence.rolling_fit(T.track_points(spark, sf_dir), 7, "tp", "x").drop("intercept")


@query("rolling_fit", f"WITH {FITS} SELECT track, tp, {r('intercept + slope * tp AS x')} FROM sl")
def rolling_fit(spark, sf_dir):
    return persistence.rolling_fit(T.track_points(spark, sf_dir), 7, "tp", "x").select("track", "tp", (F.col("intercept") + F.col("slope") * F.col("tp")).alias("x"))


@query("flat_runs", f"WITH {FLAT} SELECT * FROM fr")
def flat_runs(spark, sf_dir):
    return flat_stretches(spark, sf_dir)


@query("persistence_islands", f"""WITH {FLAT}, st AS (SELECT track, tp, t, x, y, lead(t) OVER w - t AS dt, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS ds FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  il AS (SELECT fr.track, start, stop, sum(dt) AS duration, sum(ds) AS distance, sqrt(power(max_by(x, tp) - min_by(x, tp), 2) + power(max_by(y, tp) - min_by(y, tp), 2)) AS displacement, avg(CASE WHEN dt > 0 THEN ds / dt END) AS speed, min(t) AS b, max(t) AS e
  FROM fr JOIN st ON st.track = fr.track AND st.tp BETWEEN start AND stop AND dt IS NOT NULL GROUP BY ALL)
  SELECT track, start, stop, {r('duration', 'distance', 'displacement', 'speed', 'b - lag(e) OVER (PARTITION BY track ORDER BY start) AS gap')} FROM il""")
def persistence_islands(spark, sf_dir):
    return persistence.islands(T.track_points(spark, sf_dir), flat_stretches(spark, sf_dir))


@query("persistence_scalars", f"""WITH {FLAT}, st AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  g AS (SELECT track, count(*) AS n, max(t) - min(t) AS duration, sum(step) AS distance, sqrt(power(max_by(x, tp) - min_by(x, tp), 2) + power(max_by(y, tp) - min_by(y, tp), 2)) AS displacement FROM st GROUP BY track), h AS (SELECT track, sum(n - 1) AS held FROM fr GROUP BY track)
  SELECT track, {r('duration', 'distance', 'displacement', 'CASE WHEN distance > 0 THEN displacement / distance END AS straightness', 'CASE WHEN duration > 0 THEN displacement / duration END AS velocity', 'CASE WHEN duration > 0 THEN distance / duration END AS speed', 'coalesce(held, 0) / n AS persistent', '1 - coalesce(held, 0) / n AS quiescent')} FROM g LEFT JOIN h USING (track)""")
def persistence_scalars(spark, sf_dir):
    return persistence.scalars(T.track_points(spark, sf_dir), flat_stretches(spark, sf_dir))


@query("smoothed_positions", f"""WITH {POINTS}, wi AS (SELECT *, regr_slope(x, t) OVER w AS sx, regr_intercept(x, t) OVER w AS ix, regr_slope(y, t) OVER w AS sy, regr_intercept(y, t) OVER w AS iy, count(*) OVER w AS k, count(*) OVER v AS n, min(t) OVER v AS t0, (max(t) OVER v - min(t) OVER v) / (count(*) OVER v * 2 - 1) AS step
  FROM tp WINDOW v AS (PARTITION BY track), w AS (PARTITION BY track ORDER BY tp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  ti AS (SELECT track, n, unnest(range(n * 2)) AS place, t0, step FROM (SELECT DISTINCT track, n, t0, step FROM wi) WHERE step > 0),
  a AS (SELECT ti.track, place, t0 + place * step AS moment, CASE WHEN place = n * 2 - 1 THEN n - 1 ELSE (SELECT max(p.tp) FROM tp p WHERE p.track = ti.track AND ceil((p.t - t0) / step) <= place) END AS own, n FROM ti)
  SELECT a.track, place, {r('moment AS t', 'ix + sx * moment AS x', 'iy + sy * moment AS y')} FROM a JOIN wi ON wi.track = a.track AND wi.k = 5 AND wi.tp = least(greatest(a.own, 2), a.n - 3)""")
def smoothed_positions(spark, sf_dir):
    return persistence.smoothed(T.track_points(spark, sf_dir), 5, 2)


@query("frame_means", f"WITH {POINTS} SELECT track, CAST(floor(t / 720) AS BIGINT) AS frame, {r('avg(x) AS x_mean')}, count(*) AS n FROM tp GROUP BY track, floor(t / 720)")
def frame_means(spark, sf_dir):
    return tracks.frame_means(T.track_points(spark, sf_dir), 720, "x")


@query("aligned_series", """WITH s AS (SELECT event_type AS series, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tp, sum(value) AS v FROM events WHERE value > 60 GROUP BY ALL)
  SELECT n.series, l.tp, round(s.v, 2) AS value FROM (SELECT DISTINCT series FROM s) n CROSS JOIN (SELECT CAST(unnest(range(min(tp), max(tp) + 1)) AS INTEGER) AS tp FROM s) l LEFT JOIN s ON s.series = n.series AND s.tp = l.tp""", 2)
def aligned_series(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").filter("value > 60")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return tracks.aligned(rows.groupBy(F.col("event_type").alias("series"), day.alias("tp")).agg(F.sum("value").alias("value")))


@query("scaled_tracks", f"WITH {POINTS} SELECT track, tp, {r('round(avg(x) OVER w, 6) + (x - round(avg(x) OVER w, 6)) * 0.3712345678 AS x', 'round(avg(y) OVER w, 6) + (y - round(avg(y) OVER w, 6)) * 0.3712345678 AS y')} FROM tp WINDOW w AS (PARTITION BY track)")
def scaled_tracks(spark, sf_dir):
    return tracks.scaled(T.track_points(spark, sf_dir), 0.3712345678)


@query("detection_filter", f"WITH {FRAMES} SELECT tp, pt, {r('x / 500 * 1000 AS px', '(1 - y / 100) * 1000 AS py')} FROM de WHERE score >= 0.1")
def detection_filter(spark, sf_dir):
    return T.detections(spark, sf_dir).filter("score >= 0.1").select("tp", "pt", (F.col("x") / 500 * 1000).alias("px"), ((1 - F.col("y") / 100) * 1000).alias("py"))


@query("radius_join", f"WITH {PAIRS} SELECT tp, pt1, pt2, {r('dist')} FROM pr")
def radius_join(spark, sf_dir):
    return spatial.next_frames(T.detections(spark, sf_dir), RADIUS, strict=True).select("tp", "pt1", "pt2", "dist")


@query("nearest_pairs", f"WITH {PAIRS} SELECT tp, pt1, pt2, {r('dist')} FROM ne")
def nearest_pairs(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    return spatial.nearest_links(points, spatial.earlier(points), RADIUS)


@query("mutual_pairs", f"""WITH {PAIRS} SELECT tp, pt1, pt2, {r('dist')} FROM pr
  QUALIFY row_number() OVER (PARTITION BY tp, pt1 ORDER BY dist, pt2) = 1 AND row_number() OVER (PARTITION BY tp, pt2 ORDER BY dist, pt1) = 1""")
def mutual_pairs(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    return spatial.mutual_links(points, spatial.earlier(points), RADIUS)


@query("match_counts", f"""WITH {PAIRS}, mu AS (SELECT tp FROM pr QUALIFY row_number() OVER (PARTITION BY tp, pt1 ORDER BY dist, pt2) = 1 AND row_number() OVER (PARTITION BY tp, pt2 ORDER BY dist, pt1) = 1),
  a AS (SELECT tp, count(*) AS n1 FROM de GROUP BY tp), b AS (SELECT tp - 1 AS tp, count(*) AS n2 FROM de GROUP BY tp), h AS (SELECT tp, count(*) AS k FROM mu GROUP BY tp),
  z AS (SELECT tp, coalesce(k, 0) AS matched, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM a FULL JOIN b USING (tp) LEFT JOIN h USING (tp))
  SELECT tp, matched, n1 - matched AS missed, n2 - matched AS extra, {r('CASE WHEN n2 > 0 THEN matched / n2 END AS precision', 'CASE WHEN n1 > 0 THEN matched / n1 END AS recall', 'CASE WHEN n1 + n2 - matched > 0 THEN matched / (n1 + n2 - matched) END AS agreement')} FROM z""")
def match_counts(spark, sf_dir):
    points = T.detections(spark, sf_dir).select("tp", "pt", "x", "y")
    return spatial.match_counts(points, points.withColumn("tp", F.col("tp") - 1), RADIUS - 1e-9)


@query("isolated_points", f"""WITH {PAIRS} SELECT tp, pt, {r('x', 'y')} FROM de WHERE
  ((tp, pt) IN (SELECT (tp, pt1) FROM pr) OR tp + 1 NOT IN (SELECT tp FROM de)) AND ((tp, pt) IN (SELECT (tp + 1, pt2) FROM pr) OR tp - 1 NOT IN (SELECT tp FROM de))""")
def isolated_points(spark, sf_dir):
    return spatial.without_isolated(T.detections(spark, sf_dir).select("tp", "pt", "x", "y"), RADIUS)


@query("merged_points", f"""WITH {PAIRS}, n2 AS (SELECT tp - 1 AS tp, pt, x, y FROM de)
  SELECT tp, 'pair' AS kind, pt1, pt2, round((x1 + x2) / 2, 4) AS x, round((y1 + y2) / 2, 4) AS y FROM pr JOIN ne USING (tp, pt1, pt2)
  UNION ALL SELECT tp, 'first', pt, NULL, round(x, 4), round(y, 4) FROM de WHERE (tp, pt) NOT IN (SELECT (tp, pt1) FROM ne)
  UNION ALL SELECT tp, 'second', NULL, pt, round(x, 4), round(y, 4) FROM n2 WHERE (tp, pt) NOT IN (SELECT (tp, pt2) FROM ne)""")
def merged_points(spark, sf_dir):
    points = T.detections(spark, sf_dir).select("tp", "pt", "x", "y")
    return spatial.merged(points, points.withColumn("tp", F.col("tp") - 1), RADIUS)


@query("linked_tracks", f"""WITH RECURSIVE {PAIRS}, bk AS (SELECT tp + 1 AS tp, pt2 AS pt, pt1 FROM ne),
  ch AS (SELECT tp, pt, tp AS root_tp, pt AS root_pt, 0 AS depth FROM de WHERE (tp, pt) NOT IN (SELECT (tp, pt) FROM bk)
  UNION ALL SELECT bk.tp, bk.pt, ch.root_tp, ch.root_pt, ch.depth + 1 FROM ch JOIN bk ON bk.tp = ch.tp + 1 AND bk.pt1 = ch.pt) SELECT * FROM ch""")
def linked_tracks(spark, sf_dir):
    points = T.detections(spark, sf_dir)
    return linking.chains(points, spatial.nearest_links(points, spatial.earlier(points), RADIUS))


ENDS = FRAMES + """, e AS (SELECT pt AS track, tp * 2.0 AS t0, x AS x0, y AS y0, tp * 2.0 + 1 AS t1, x AS x1, y AS y1 FROM de)"""


def _ends(spark, sf_dir):
    return T.detections(spark, sf_dir).select(F.col("pt").alias("track"), F.lit(1).alias("n"), (F.col("tp") * 2.0).alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("tp") * 2.0 + 1).alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"))


@query("gap_candidates", f"""WITH {ENDS}, c AS (SELECT b.track, a.track AS before, b.t0 - a.t1 AS lag, sqrt(power(a.x1 - b.x0, 2) + power(a.y1 - b.y0, 2)) AS dist FROM e a JOIN e b ON a.track <> b.track AND b.t0 - a.t1 > 0 AND b.t0 - a.t1 <= 3.5 AND abs(a.x1 - b.x0) <= 6
  WHERE sqrt(power(a.x1 - b.x0, 2) + power(a.y1 - b.y0, 2)) <= 6 QUALIFY row_number() OVER (PARTITION BY b.track ORDER BY lag, dist, before) = 1) SELECT track, before, {r('lag', 'dist')} FROM c""")
def gap_candidates(spark, sf_dir):
    return spatial.gap_candidates(_ends(spark, sf_dir), 3.5, 6)


@query("closed_tracks")
def closed_tracks(spark, sf_dir):
    return linking.closed(_ends(spark, sf_dir), 1.5, 3)


def _orders(spark, sf_dir):
    lines, orders = T.read(spark, sf_dir, "lineitem"), T.read(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_orderpriority").alias("cond"), F.col("l_extendedprice").alias("score"))


@query("category_summary", f"""SELECT l_returnflag AS cond, l_linestatus AS stage, {r(*[f'quantile_cont(l_extendedprice, {p}) AS p{round(p * 100):02d}' for p in groups.PERCENTILES], 'avg(l_extendedprice) AS mean', 'stddev_pop(l_extendedprice) AS std', decimals=2)},
  count(*) AS n FROM lineitem GROUP BY ALL""", 2)
def category_summary(spark, sf_dir):
    return groups.category_summary(T.observations(spark, sf_dir), ["cond", "stage"], "score")


def _bins(equal_area: bool) -> str:
    edges = groups.bin_edges(3, equal_area)
    case = " ".join(f"WHEN q >= {a!r} AND q < {1.1 if b == edges[-1] else b!r} THEN '{a:.1f}-{b:.1f}'" for a, b in zip(edges, edges[1:], strict=False))
    return f"WITH o AS (SELECT l_quantity / 50 AS q, l_extendedprice AS s FROM lineitem), b AS (SELECT CASE {case} END AS bin, s FROM o) SELECT bin, count(*) AS n, round(avg(s), 2) AS mean FROM b WHERE bin IS NOT NULL GROUP BY bin"


def _radial(equal_area: bool):
    def run(spark, sf_dir):
        rows = T.observations(spark, sf_dir).withColumn("radius", F.col("quantity") / 50)
        return groups.radial_bins(rows, "radius", 3, equal_area).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))

    return run


query("radial_bins_equal_width", _bins(False), 2)(_radial(False))
query("radial_bins_equal_area", _bins(True), 2)(_radial(True))


@query("pairwise_effect", f"""WITH {LEVELS} SELECT a.cond AS level1, b.cond AS level2, round(abs(a.m - b.m) / sqrt(((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) / (a.n + b.n)), 6) AS effect FROM lv a JOIN lv b ON a.cond < b.cond""", 6)
def pairwise_effect(spark, sf_dir):
    return groups.level_pairs(groups.moments(_orders(spark, sf_dir), "cond", "score"), "cond").select("level1", "level2", groups.effect_size().alias("effect"))


@query("pairwise_welch", f"""WITH {LEVELS} SELECT a.cond AS level1, b.cond AS level2, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t,
  round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 3) AS df FROM lv a JOIN lv b ON a.cond < b.cond""", 5)
def pairwise_welch(spark, sf_dir):
    return groups.pairwise_t(_orders(spark, sf_dir), "cond", "score").select("level1", "level2", "t", F.round("df", 3).alias("df"))


def student_sql(t: str, df: str) -> str:
    """SQL: two-sided p-value of Student's t, the density summed by Simpson's rule on 4000 steps."""
    density = f"pow(1 + pow(k * abs({t}) / 4000, 2) / ({df}), -(({df}) + 1) / 2)"
    area = f"list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * {density})) * abs({t}) / 12000"
    return f"greatest(0, 1 - 2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) * {area})"


@query("pairwise_significance", f"""WITH {LEVELS}, te AS (SELECT a.cond AS level1, b.cond AS level2, (a.n + b.n - 2)::DOUBLE AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t,
    abs(a.m - b.m) / sqrt(((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) / (a.n + b.n)) AS effect FROM lv a JOIN lv b ON a.cond < b.cond), tp AS (SELECT *, {student_sql('t', 'df')} AS p FROM te),
  k AS (SELECT *, row_number() OVER (ORDER BY p, level1, level2) AS k, count(*) OVER () AS m FROM tp)
  SELECT level1, level2, {r('t', 'df', 'effect', 'p', 'least(1, max((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS adjusted', decimals=6)} FROM k""", 6)
def pairwise_significance(spark, sf_dir):
    return groups.significance(_orders(spark, sf_dir), "cond", "score", keep_all=True)


@query("anova", f"""WITH {LEVELS}, t AS (SELECT count(*) AS k, sum(n) AS n, sum(m * n) AS s, sum(m * m * n) AS b FROM lv), q AS (SELECT sum(score * score) AS q FROM ob)
  SELECT CAST(k - 1 AS BIGINT) AS df, CAST(n - k AS BIGINT) AS df_residual, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM t, q""")
def anova(spark, sf_dir):
    return groups.anova(_orders(spark, sf_dir), "cond", "score").select("df", "df_residual", "f")


@query("score_curve", f"WITH {TRUTH} SELECT score, tp, fp, {r('tp / np AS tpr', 'fp / nq AS fpr', 'tp / (tp + fp) AS precision', decimals=6)} FROM cu", 6)
def score_curve(spark, sf_dir):
    return groups.score_curve(T.scored_truth(spark, sf_dir))


@query("roc_summary", f"""WITH {TRUTH}, c AS (SELECT score, tp / np AS tpr, fp / nq AS fpr FROM cu), a AS (SELECT *, lag(tpr, 1, 0) OVER w AS t0, lag(fpr, 1, 0) OVER w AS f0 FROM c WINDOW w AS (ORDER BY score DESC))
  SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc, (SELECT score FROM c ORDER BY round(power(fpr, 2) + power(1 - tpr, 2), 9), score DESC LIMIT 1) AS knee FROM a""", 6)
def roc_summary(spark, sf_dir):
    return groups.roc_summary(groups.score_curve(T.scored_truth(spark, sf_dir)))


@query("histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS total FROM events), c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1)
  SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + (b.bin + 0.5) * (hi - lo) / 40, 8) AS centre, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 8) AS share FROM e, (SELECT unnest(range(40)) AS bin) b LEFT JOIN c ON c.bin = b.bin""", 8)
def histogram(spark, sf_dir):
    return groups.histogram(T.read(spark, sf_dir, "events"), "value", 40)


@query("extreme_filter", "WITH b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, value FROM events, b WHERE value BETWEEN m - 2 * s AND m + 2 * s")
def extreme_filter(spark, sf_dir):
    return groups.without_extremes(T.read(spark, sf_dir, "events").select("event_id", "value"), "value", 2)


@query("outlier_bands", """WITH b AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), z AS (SELECT event_type, (value - m) / s AS z FROM events JOIN b USING (event_type))
  SELECT event_type, CAST(count(*) FILTER (z > 2 AND z <= 5) AS BIGINT) AS above, CAST(count(*) FILTER (z < -2 AND z >= -5) AS BIGINT) AS below, count(*) AS n, round((count(*) FILTER (abs(z) > 2 AND abs(z) <= 5)) / count(*), 4) AS share FROM z GROUP BY 1""")
def outlier_bands(spark, sf_dir):
    return groups.outlier_bands(T.read(spark, sf_dir, "events"), "event_type", "value", 2, 5)


@query("contrast_groups", """WITH o AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM o WHERE o_custkey IN (SELECT o_custkey FROM o GROUP BY 1 HAVING count(*) > 1)""")
def contrast_groups(spark, sf_dir):
    return groups.contrast_groups(T.read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))


@query("column_subset", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_quantity IN (1, 2, 3)")
def column_subset(spark, sf_dir):
    rows = T.read(spark, sf_dir, "lineitem")
    for column, values in {"l_returnflag": ["A", "R"], "l_linestatus": ["F"], "l_quantity": [1, 2, 3]}.items():
        rows = rows.filter(F.col(column).isin(values))
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate")


@query("compartments", """WITH c AS (SELECT c_custkey AS entity, c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer)
  SELECT bin, round(avg(v), 4) AS mean, round(min(v), 4) AS low, round(max(v), 4) AS high, count(*) AS n FROM c, (SELECT unnest(range(5)) AS bin) b WHERE k >= floor((n - 100) * bin / 4) AND k < floor((n - 100) * bin / 4) + 100 AND n >= 100 GROUP BY bin""")
def compartments(spark, sf_dir):
    rows = T.read(spark, sf_dir, "customer")
    out = groups.compartments(rows, "c_custkey", "c_acctbal", 5, 100).groupBy("bin").agg(F.avg("c_acctbal").alias("mean"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count("*").alias("n"))
    return out.withColumn("bin", F.col("bin").cast("long"))


@query("data_split", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7/' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN k <= round(n * 0.1) THEN 'test' WHEN k <= round(n * 0.1) + round(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM o""")
def data_split(spark, sf_dir):
    return groups.hashed_split(T.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "7", 0.1, 0.1)


@query("annotation_dedup", f"WITH {BOXES} SELECT * FROM bn")
def annotation_dedup(spark, sf_dir):
    return annotations.deduplicated(T.annotations(spark, sf_dir))


@query("annotation_files", f"WITH {BOXES} SELECT file, count(*) AS n, count(DISTINCT sel_class) AS classes FROM bn WHERE file <> 3 GROUP BY file")
def annotation_files(spark, sf_dir):
    return annotations.files(annotations.cleared(annotations.deduplicated(T.annotations(spark, sf_dir)), 3))


@query("annotation_replace", f"WITH {BOXES} SELECT * FROM bn WHERE file NOT IN (SELECT file FROM bn WHERE sel_class = 'error' AND x1 > 300) UNION ALL SELECT * FROM bn WHERE sel_class = 'error' AND x1 > 300")
def annotation_replace(spark, sf_dir):
    boxes = annotations.deduplicated(T.annotations(spark, sf_dir))
    return annotations.replaced(boxes, boxes.filter("sel_class = 'error' and x1 > 300"))


@query("catalog_fields", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), ''), 'none') AS channel,
  coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT), 0) AS timepoint FROM pages""")
def catalog_fields(spark, sf_dir):
    url = F.col("url")
    channel = F.regexp_extract(url, "/([a-z]{2})/[0-9]+", 1)
    return T.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)/", 1).alias("host"), F.when(channel != "", channel).otherwise("none").alias("channel"), F.coalesce(F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)"), F.lit(0)).alias("timepoint"))


@query("track_complement", "SELECT DISTINCT user_id AS track FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)")
def track_complement(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events")
    listed = rows.filter("event_type = 'error' and value > 150").select("user_id").distinct()
    return rows.select("user_id").distinct().join(listed, "user_id", "left_anti").withColumnRenamed("user_id", "track")


def wide(vertices) -> list:
    """A polygon widened by 1e-5 about its centroid."""
    pairs = list(zip(vertices, vertices[1:] + vertices[:1], strict=True))
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)
    cx, cy = (sum((a[i] + b[i]) * (a[0] * b[1] - b[0] * a[1]) for a, b in pairs) / (3 * twice) for i in (0, 1))
    return [(cx + (x - cx) * (1 + 1e-5), cy + (y - cy) * (1 + 1e-5)) for x, y in vertices]


def _inside() -> str:
    corners = wide(HEX)
    terms = [f"CASE WHEN ({a[1]} > y) <> ({b[1]} > y) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    return f"WITH c AS (SELECT vec_id AS pt, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings) SELECT pt, label FROM c WHERE ({' + '.join(terms)}) % 2 = 1"


@query("points_in_roi", _inside())
def points_in_roi(spark, sf_dir):
    return lookups.points_in(T.cloud(spark, sf_dir), HEX).select("pt", "label")


@query("box_polygons", f"WITH {BOXES} SELECT file, sel_class, {r('(x1 - x0) * (y1 - y0) AS area', '2 * (x1 - x0) + 2 * (y1 - y0) AS perimeter', '(x0 + x1) / 2 AS cx', '(y0 + y1) / 2 AS cy')} FROM bn")
def box_polygons(spark, sf_dir):
    b = annotations.deduplicated(T.annotations(spark, sf_dir))
    v = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    b = b.withColumn("v", v)
    return b.select("file", "sel_class", geometry.area(F.col("v")).alias("area"), geometry.perimeter(F.col("v")).alias("perimeter"), geometry.centroid(F.col("v"))["x"].alias("cx"), geometry.centroid(F.col("v"))["y"].alias("cy"))


@query("pixel_contrast", f"""WITH {PIXELS}, m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image))
  SELECT image, "row", col, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) WHEN value > 0 THEN 1 ELSE 0 END, 4) AS value FROM m""")
def pixel_contrast(spark, sf_dir):
    return pixels.contrast(T.pixels(spark, sf_dir))


@query("pixel_blocks", f'WITH {PIXELS} SELECT image, CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, round(sum(value) / 4, 4) AS value FROM px GROUP BY image, "row" // 2, col // 2')
def pixel_blocks(spark, sf_dir):
    return pixels.block_mean(T.pixels(spark, sf_dir), 2)


@query("pixel_peaks", f"""WITH {PIXELS} SELECT image, "row", col, value FROM px a WHERE value > 30 AND NOT EXISTS (SELECT 1 FROM px b WHERE b.image = a.image AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1
  AND (b.value > a.value OR (b.value = a.value AND (b."row" < a."row" OR (b."row" = a."row" AND b.col < a.col)))))""")
def pixel_peaks(spark, sf_dir):
    return pixels.peaks(T.pixels(spark, sf_dir), 1, 30)


@query("unwrapped_heading", f"""WITH {NEXT}, h AS (SELECT track, tp, atan2(dy, dx) AS a FROM ve), u AS (SELECT *, coalesce(round((a - lag(a) OVER (PARTITION BY track ORDER BY tp)) / (2 * pi())), 0) AS k FROM h)
  SELECT track, tp, round(degrees(a - 2 * pi() * sum(k) OVER (PARTITION BY track ORDER BY tp ROWS UNBOUNDED PRECEDING)), 4) AS angle FROM u""")
def unwrapped_heading(spark, sf_dir):
    return series.unwrapped(tracks.velocity(T.track_points(spark, sf_dir)), "heading")


@query("gaussian_smooth", f"""WITH {POINTS}, k AS (SELECT k, exp(-k * k / 2.0) / sum(exp(-k * k / 2.0)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS k)),
  p AS (SELECT track, tp, count(*) OVER (PARTITION BY track) AS n FROM tp), s AS (SELECT track, tp, n, w, ((tp + k) % (2 * n) + 2 * n) % (2 * n) AS m FROM p, k)
  SELECT s.track, s.tp, round(sum(w * x), 4) AS x_smooth FROM s JOIN tp v ON v.track = s.track AND v.tp = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL""")
def gaussian_smooth(spark, sf_dir):
    return series.gaussian(T.track_points(spark, sf_dir), "x")


@query("even_timeline", f"""WITH {POINTS}, g AS (SELECT track, t / 720 AS t0, lead(t / 720) OVER w AS t1, x, lead(x) OVER w AS x1 FROM tp WINDOW w AS (PARTITION BY track ORDER BY tp)),
  e AS (SELECT *, unnest(range(CAST(ceil(t0) AS BIGINT), CAST(CASE WHEN t1 IS NULL THEN floor(t0) + 1 ELSE ceil(t1) END AS BIGINT))) AS frame FROM g)
  SELECT track, frame, round(CASE WHEN t1 IS NULL THEN x ELSE x + (x1 - x) * (frame - t0) / (t1 - t0) END, 4) AS x FROM e""")
def even_timeline(spark, sf_dir):
    return series.even(T.track_points(spark, sf_dir).withColumn("t", F.col("t") / 720), "t", ["x"])


@query("widest_waveforms", f"""WITH {POINTS}, g AS (SELECT track, row_number() OVER (ORDER BY max(x) - min(x) DESC, track) - 1 AS rank FROM tp GROUP BY track HAVING count(*) > 1)
  SELECT track, CAST(rank AS INTEGER) AS rank, tp, round(coalesce(x, 0) + rank * 50, 4) AS x FROM tp JOIN g USING (track) WHERE rank < 10""")
def widest_waveforms(spark, sf_dir):
    return series.waveforms(T.track_points(spark, sf_dir), "x", 10, 50)


@query("adjacent_frames", """WITH d AS (SELECT DISTINCT user_id AS series, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tp FROM events)
  SELECT a.series, a.tp, b.tp AS next FROM d a JOIN d b ON a.series = b.series AND b.tp = a.tp + 1""")
def adjacent_frames(spark, sf_dir):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return series.adjacent(T.read(spark, sf_dir, "events").select(F.col("user_id").alias("series"), day.alias("tp")).distinct(), ["series"], "tp")


@query("timeline_complement", f"WITH {FRAMES}, u AS (SELECT tp, pt FROM de WHERE score > 0.5 UNION SELECT tp, pt FROM de WHERE score < 0.001) SELECT tp, pt FROM de WHERE tp IN (SELECT tp FROM u) AND (tp, pt) NOT IN (SELECT (tp, pt) FROM u)")
def timeline_complement(spark, sf_dir):
    d = T.detections(spark, sf_dir)
    return series.timeline_complement(d, d.filter("score > 0.5"), d.filter("score < 0.001"))


@query("pixel_correlation", f"""WITH {PIXELS} SELECT a.image, count(*) AS n, CASE WHEN NOT isnan(corr(a.value, b.value)) THEN round(corr(a.value, b.value), 4) END AS correlation FROM px a JOIN px b ON b."row" = a."row" AND b.col = a.col AND b.image = 'I0' GROUP BY a.image""")
def pixel_correlation(spark, sf_dir):
    return pixels.correlation(T.pixels(spark, sf_dir), "I0")


@query("pixel_median", f"""WITH {PIXELS} SELECT a.image, a."row", a.col, round(median(b.value), 4) AS value FROM px a JOIN px b ON b.image = a.image AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 GROUP BY ALL""")
def pixel_median(spark, sf_dir):
    return pixels.median_filter(T.pixels(spark, sf_dir), 1)


@query("pixel_trim", f"""WITH {PIXELS}, m AS (SELECT image, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM px WHERE value > 45 GROUP BY image)
  SELECT px.* FROM px JOIN m USING (image) WHERE "row" BETWEEN r0 - 1 AND r1 + 1 AND col BETWEEN c0 - 1 AND c1 + 1""")
def pixel_trim(spark, sf_dir):
    return pixels.trimmed(T.pixels(spark, sf_dir), 45, 1)


@query("replicate_means", f"""SELECT l_returnflag, l_suppkey, {r('avg(l_extendedprice) AS mean', 'stddev_pop(l_extendedprice) AS std', decimals=2)}, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 3""", 2)
def replicate_means(spark, sf_dir):
    return groups.replicate_means(T.read(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice")


@query("kernel_density", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM events), b AS (SELECT least(floor((value - lo) / ((hi - lo) / 1024)), 1023) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1)
  SELECT CAST(place AS INTEGER) AS place, round(lo + place * (hi - lo) / 99, 6) AS at, round(sum(n * exp(-power((place * (hi - lo) / 99 - (bin + 0.5) * (hi - lo) / 1024) / 5, 2) / 2) / (5 * sqrt(2 * pi())) / total), 6) AS density
  FROM b, e, (SELECT unnest(range(100)) AS place) GROUP BY place, lo, hi""", 6)
def kernel_density(spark, sf_dir):
    return groups.density(T.read(spark, sf_dir, "events"), "value", 5.0)


@query("natural_order", """WITH c AS (SELECT DISTINCT c FROM (SELECT CAST(p_size AS VARCHAR) AS c FROM part UNION ALL SELECT p_brand FROM part)) SELECT c, CAST(row_number() OVER (ORDER BY TRY_CAST(c AS BIGINT) NULLS LAST, c) AS INTEGER) AS place FROM c""")
def natural_order(spark, sf_dir):
    part = T.read(spark, sf_dir, "part")
    return groups.natural_order(part.select(F.col("p_size").cast("string").alias("c")).union(part.select("p_brand")), "c")


@query("percent_subset", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3/' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM o WHERE k <= round(n * 0.25)""")
def percent_subset(spark, sf_dir):
    return groups.percent_subset(T.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "3", 0.25)
