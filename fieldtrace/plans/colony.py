"""Registered queries of colony parameters and their radial report."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import colony, linking, mesh, persistence, spatial
from fieldtrace.operators.written import written
from fieldtrace.plans.catalogue import RADIUS, query, r, student_sql
from fieldtrace.plans.meshes import NEAR, RIM
from fieldtrace.plans.persistence import CHAIN, CUTOFF
from fieldtrace.sources import tables as T

#: Degrees a day under which a chain's heading is persistent here.
TURN = 40.0
_OWN = CHAIN[CHAIN.index(", wi AS") :].replace(f"abs(slope) < {CUTOFF}", f"abs(slope) < {TURN}")
#: Distances from the rim's centroid by the rim's distance at that angle, of all points.
_WARP = RIM[RIM.index(", ce AS") :] + """, an AS (SELECT *, atan2(y - avg(y) OVER f, x - avg(x) OVER f) AS a FROM ri WINDOW f AS (PARTITION BY tp)),
  sd AS (SELECT tp, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM an WINDOW w AS (PARTITION BY tp ORDER BY a)),
  cc AS (SELECT tp, sum((x + u) * (x * v - u * y)) / (3 * sum(x * v - u * y)) AS cx, sum((y + v) * (x * v - u * y)) / (3 * sum(x * v - u * y)) AS cy FROM sd GROUP BY tp),
  po AS (SELECT tp, atan2(y - cy, x - cx) AS t0, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS r0 FROM ri JOIN cc USING (tp)),
  rg AS (SELECT tp, t0, r0, coalesce(lead(t0) OVER w, first(t0) OVER w + 2 * pi()) AS t1, coalesce(lead(r0) OVER w, first(r0) OVER w) AS r1 FROM po WINDOW w AS (PARTITION BY tp ORDER BY t0)),
  gr AS (SELECT tp, (k + 36) % 36 AS k, r0 + (r1 - r0) * (k * pi() / 18 - t0) / (t1 - t0) AS e FROM rg, (SELECT unnest(range(-36, 73)) AS k) WHERE k * pi() / 18 >= t0 AND k * pi() / 18 < t1),
  pp AS (SELECT tp, pt, x - cx AS dx, y - cy AS dy, atan2(y - cy, x - cx) / (pi() / 18) AS i FROM de JOIN cc USING (tp)),
  ra AS (SELECT pp.tp, pp.pt, sqrt(dx * dx + dy * dy) / (g0.e + (g1.e - g0.e) * (i - floor(i))) AS radius FROM pp JOIN gr g0 ON g0.tp = pp.tp AND g0.k = (floor(i) + 36) % 36 JOIN gr g1 ON g1.tp = pp.tp AND g1.k = (floor(i) + 37) % 36)"""
_LOCAL = """, l0 AS (SELECT bo.tp, bo.pt, p.x, p.y FROM bo JOIN de p ON p.tp = bo.tp AND p.pt = bo.near), l1 AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n FROM l0 WINDOW w AS (PARTITION BY tp, pt)),
  l2 AS (SELECT *, row_number() OVER (PARTITION BY tp, pt ORDER BY atan2(y - my, x - mx), x, y) AS k FROM l1 WHERE n >= 3),
  lo AS (SELECT a.tp, a.pt, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM l2 a JOIN l2 b ON a.tp = b.tp AND a.pt = b.pt AND b.k = a.k % a.n + 1 GROUP BY a.tp, a.pt),
  d0 AS (SELECT ne.tp, pt1, pt2, q.area - p.area AS rate FROM ne JOIN lo p ON p.tp = ne.tp AND p.pt = pt1 JOIN lo q ON q.tp = ne.tp + 1 AND q.pt = pt2), di AS (SELECT tp, pt, avg(rate) AS divergence FROM (SELECT tp, pt1 AS pt, rate FROM d0 UNION ALL SELECT tp + 1, pt2, rate FROM d0) GROUP BY tp, pt),
  c0 AS (SELECT m.tp, m.pt1, m.pt2, avg(atan2(n.y2 - m.y2, n.x2 - m.x2) - atan2(n.y1 - m.y1, n.x1 - m.x1)) AS turn FROM mo m JOIN bo ON bo.tp = m.tp AND bo.pt = m.pt1 JOIN mo n ON n.tp = m.tp AND n.pt1 = bo.near GROUP BY m.tp, m.pt1, m.pt2),
  cu AS (SELECT tp, pt, avg(turn) AS curl FROM (SELECT tp, pt1 AS pt, turn FROM c0 UNION ALL SELECT tp + 1, pt2, turn FROM c0) GROUP BY tp, pt)"""
_TRACKS = """, bk AS (SELECT tp + 1 AS tp, pt2 AS pt, pt1 FROM ne), ch AS (SELECT tp, pt, pt AS track, 0 AS depth FROM de WHERE (tp, pt) NOT IN (SELECT (tp, pt) FROM bk) UNION ALL SELECT bk.tp, bk.pt, ch.track, ch.depth + 1 FROM ch JOIN bk ON bk.tp = ch.tp + 1 AND bk.pt1 = ch.pt),
  tf AS (SELECT ch.track, ch.tp AS frame, ch.pt, ch.depth, de.x, de.y FROM ch JOIN de USING (tp, pt)), tp AS (SELECT track, depth AS tp, frame::DOUBLE AS t, x, y FROM tf),
  st AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step, sqrt(power(x - first(x) OVER w, 2) + power(y - first(y) OVER w, 2)) AS displacement FROM tf WINDOW w AS (PARTITION BY track ORDER BY depth)),
  mt AS (SELECT track, frame AS tp, pt, displacement, sum(step) OVER (PARTITION BY track ORDER BY depth) AS distance FROM st)"""
_FIELDS = f"""WITH RECURSIVE {NEAR}{_WARP}{_LOCAL}{_TRACKS}{_OWN},
  wf AS (SELECT ro.track, floor(ro.t)::INTEGER AS tp, avg((fr.track IS NOT NULL)::INTEGER) AS persistence FROM ro LEFT JOIN fr ON fr.track = ro.track AND ro.place >= start AND ro.place < stop GROUP BY ro.track, floor(ro.t)),
  fi AS (SELECT mt.*, radius, area, CASE WHEN area IS NOT NULL THEN 1 / greatest(area, 1) END AS density, divergence, curl, persistence FROM mt LEFT JOIN ra ON ra.tp = mt.tp AND ra.pt = mt.pt LEFT JOIN lo ON lo.tp = mt.tp AND lo.pt = mt.pt LEFT JOIN di ON di.tp = mt.tp AND di.pt = mt.pt LEFT JOIN cu ON cu.tp = mt.tp AND cu.pt = mt.pt LEFT JOIN wf ON wf.track = mt.track AND wf.tp = mt.tp),
  ag AS (SELECT track, avg(radius) AS radius, avg(persistence) AS persistence, avg(density) AS density, avg(area) AS area, avg(divergence) AS divergence, avg(curl) AS curl, max(distance) AS distance, max(displacement) AS displacement, max(tp)::DOUBLE AS t FROM fi GROUP BY track),
  pa AS (SELECT *, CASE WHEN t > 0 THEN displacement / t END AS velocity, CASE WHEN t > 0 THEN distance / t END AS speed, CASE WHEN distance > 0 THEN displacement / distance END AS disp_to_dist FROM ag)"""


def _parameters(spark, sf_dir):
    points = written(T.detections(spark, sf_dir).select("tp", "pt", "x", "y"))
    links = written(spatial.nearest_links(points, spatial.earlier(points), RADIUS))
    local = written(mesh.radius_density(points, RADIUS))
    chains = linking.chains(points, links)
    rows = points.join(chains.hint("merge"), ["tp", "pt"]).select(F.col("root_pt").alias("track"), "tp", "pt", "x", "y")
    warped = mesh.warped(points, mesh.sector_rim(points, 12), 36)
    radii = warped.select("tp", "pt", F.hypot("x", "y").alias("radius"))
    long = rows.join(rows.groupBy("track").agg(F.count("*").alias("n")).filter("n >= 7").select("track").hint("merge"), "track", "left_semi")
    chain = persistence.timeline(long.withColumn("t", F.col("tp").cast("double")), cutoff=TURN)
    return colony.parameters(colony.fields(rows, RADIUS, links, radii, chain, local=local))


@query("colony_parameters", f"{_FIELDS} SELECT track, {r('radius', *colony.NAMES, decimals=3)} FROM pa", 3)
def colony_parameters(spark, sf_dir):
    return _parameters(spark, sf_dir)


_EDGES = " ".join(f"WHEN radius >= {a!r} AND radius < {1.1 if i == 2 else b!r} THEN '{a:.2f}-{b:.2f}'" for i, (a, b) in enumerate(zip(colony.groups.bin_edges(3, True), colony.groups.bin_edges(3, True)[1:], strict=False)))


_RINGS = f"""{_FIELDS}, bi AS (SELECT *, CASE {_EDGES} END AS bin FROM pa), lg AS ({' UNION ALL '.join(f"SELECT bin, '{n}' AS name, {n}::DOUBLE AS v FROM bi WHERE bin IS NOT NULL" for n in colony.NAMES)}),
  ow AS (SELECT name, bin, count(v) AS n, avg(v) AS m, var_samp(v) AS s FROM lg GROUP BY name, bin HAVING count(v) > 1),
  pr2 AS (SELECT a.name, a.bin AS bin1, b.bin AS bin2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.n + b.n - 2 AS df, ((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) AS v FROM ow a JOIN ow b ON a.name = b.name AND a.bin < b.bin)
, rt AS (SELECT name, bin1, bin2, n1, n2, (m1 - m2) / sqrt(v * (1 / n1 + 1 / n2)) AS statistic, df::DOUBLE AS df FROM pr2 WHERE v > 0)"""


@query("ring_tests", f"{_RINGS} SELECT name, bin1, bin2, n1, n2, round(statistic, 3) AS statistic, df FROM rt", 3)
def ring_tests(spark, sf_dir):
    return colony.ring_tests(_parameters(spark, sf_dir))


@query("radial_significance", f"""{_RINGS}, rp AS (SELECT *, {student_sql('statistic', 'df')} AS p FROM rt), rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, bin1, bin2) AS k, count(*) OVER (PARTITION BY name) AS m FROM rp)
  SELECT name, bin1, bin2, n1, n2, {r('statistic', 'df', 'p', 'least(1, max((m - k + 1) * p) OVER (PARTITION BY name ORDER BY k ROWS UNBOUNDED PRECEDING)) AS adjusted', decimals=5)} FROM rk""", 5)
def radial_significance(spark, sf_dir):
    return colony.radial_significance(_parameters(spark, sf_dir))
