"""Registered queries on meshes and neighbour graphs."""

from __future__ import annotations

from fieldtrace.operators import linking, mesh, spatial
from fieldtrace.plans.catalogue import FRAMES, PAIRS, RADIUS, query, r
from fieldtrace.sources import tables as T

NEAR = PAIRS + f""", ed AS (SELECT a.tp, a.pt AS a, b.pt AS b FROM de a JOIN de b ON a.tp = b.tp AND a.pt < b.pt AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS}
  WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= {RADIUS}), bo AS (SELECT tp, a AS pt, b AS near FROM ed UNION ALL SELECT tp, b, a FROM ed),
  mo AS (SELECT ne.tp, ne.pt1, ne.pt2, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM ne JOIN de p ON p.tp = ne.tp AND p.pt = ne.pt1 JOIN de q ON q.tp = ne.tp + 1 AND q.pt = ne.pt2)"""


def _graph(spark, sf_dir):
    """Detections, the edges of their radius graph, and nearest links to the next frame."""
    d = T.detections(spark, sf_dir)
    return d, spatial.radius_edges(d, RADIUS), spatial.nearest_links(d, spatial.earlier(d), RADIUS)


@query("radius_edges", f"WITH {NEAR} SELECT tp, a, b FROM ed")
def radius_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query("two_hops", f"""WITH {NEAR} SELECT DISTINCT a.tp, a.pt, b.near FROM bo a JOIN bo b ON a.tp = b.tp AND a.near = b.pt WHERE b.near <> a.pt AND (a.tp, a.pt, b.near) NOT IN (SELECT (tp, pt, near) FROM bo)""")
def two_hops(spark, sf_dir):
    return mesh.two_hops(T.detections(spark, sf_dir), RADIUS)


@query("field_divergence", f"""WITH {NEAR}, ra AS (SELECT tp, pt1, pt2, (x2 - x1) / 0.5 AS rate FROM mo) SELECT tp, pt, {r('avg(rate) AS rate')} FROM (SELECT tp, pt1 AS pt, rate FROM ra UNION ALL SELECT tp + 1, pt2, rate FROM ra) GROUP BY tp, pt""")
def field_divergence(spark, sf_dir):
    d, _, links = _graph(spark, sf_dir)
    return mesh.divergence(d, links, "x", 0.5)


@query("neighbour_rotation", f"""WITH {NEAR}, tu AS (SELECT m.tp, m.pt1, m.pt2, avg(atan2(n.y2 - m.y2, n.x2 - m.x2) - atan2(n.y1 - m.y1, n.x1 - m.x1)) AS turn
  FROM mo m JOIN bo ON bo.tp = m.tp AND bo.pt = m.pt1 JOIN mo n ON n.tp = m.tp AND n.pt1 = bo.near GROUP BY ALL) SELECT tp, pt, {r('avg(turn) AS turn')} FROM (SELECT tp, pt1 AS pt, turn FROM tu UNION ALL SELECT tp + 1, pt2, turn FROM tu) GROUP BY tp, pt""")
def neighbour_rotation(spark, sf_dir):
    d, _, links = _graph(spark, sf_dir)
    return mesh.rotation(d, RADIUS, links)


@query("imputed_points", f"""WITH {NEAR}, me AS (SELECT bo.tp, bo.pt, avg(x2 - x1) AS dx, avg(y2 - y1) AS dy, count(*) AS n FROM bo JOIN mo ON mo.tp = bo.tp AND mo.pt1 = bo.near GROUP BY ALL HAVING count(*) >= 3)
  SELECT de.tp, de.pt, {r('x + dx AS x', 'y + dy AS y')}, n FROM de JOIN me ON de.tp = me.tp AND de.pt = me.pt WHERE (de.tp, de.pt) NOT IN (SELECT (tp, pt1) FROM ne)""")
def imputed_points(spark, sf_dir):
    d, _, links = _graph(spark, sf_dir)
    return mesh.imputed(d, RADIUS, links)


@query("delaunay_mesh")
def delaunay_mesh(spark, sf_dir):
    return mesh.delaunay(T.detections(spark, sf_dir), 50.0)


@query("mesh_area")
def mesh_area(spark, sf_dir):
    return mesh.mean_area(mesh.delaunay(T.detections(spark, sf_dir), 50.0))


@query("mesh_boundary")
def mesh_boundary(spark, sf_dir):
    return mesh.boundary(mesh.delaunay(T.detections(spark, sf_dir), 50.0))


@query("clustered_points", f"""WITH {FRAMES}, h AS (SELECT b.tp, b.pt, any_value(b.x) AS x, any_value(b.y) AS y, min(a.pt) AS head FROM de a JOIN de b ON a.tp = b.tp AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS}
  WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= {RADIUS} GROUP BY b.tp, b.pt) SELECT tp, head, {r('avg(x) AS x', 'avg(y) AS y')}, count(*) AS n FROM h GROUP BY ALL""")
def clustered_points(spark, sf_dir):
    return spatial.clustered(T.detections(spark, sf_dir), RADIUS)


@query("point_groups", f"""WITH RECURSIVE {NEAR}, re AS (SELECT tp, pt, near FROM bo UNION SELECT re.tp, re.pt, bo.near FROM re JOIN bo ON re.tp = bo.tp AND re.near = bo.pt) SELECT tp, pt, min(least(near, pt)) AS root FROM re GROUP BY tp, pt""")
def point_groups(spark, sf_dir):
    return linking.radius_groups(T.detections(spark, sf_dir), RADIUS)


@query("matched_pairs")
def matched_pairs(spark, sf_dir):
    return linking.matched(spatial.crowd_pairs(T.detections(spark, sf_dir), RADIUS), RADIUS)


RIM = FRAMES + """, ce AS (SELECT tp, avg(x) AS mx, avg(y) AS my FROM de GROUP BY tp), se AS (SELECT tp, pt, x, y, floor((atan2(y - my, x - mx) + pi()) / (2 * pi()) * 12) AS s, round(power(x - mx, 2) + power(y - my, 2), 6) AS d FROM de JOIN ce USING (tp)),
  ri AS (SELECT tp, pt, x, y FROM se QUALIFY row_number() OVER (PARTITION BY tp, s ORDER BY d DESC, pt) = 1)"""


@query("sector_rim", f"WITH {RIM} SELECT tp, pt, {r('x', 'y')} FROM ri")
def sector_rim(spark, sf_dir):
    return mesh.sector_rim(T.detections(spark, sf_dir), 12)


@query("warped_points", f"""WITH {RIM}, an AS (SELECT *, atan2(y - avg(y) OVER f, x - avg(x) OVER f) AS a FROM ri WINDOW f AS (PARTITION BY tp)),
  ed AS (SELECT tp, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM an WINDOW w AS (PARTITION BY tp ORDER BY a)),
  cc AS (SELECT tp, sum((x + u) * (x * v - u * y)) / (3 * sum(x * v - u * y)) AS cx, sum((y + v) * (x * v - u * y)) / (3 * sum(x * v - u * y)) AS cy FROM ed GROUP BY tp),
  po AS (SELECT tp, atan2(y - cy, x - cx) AS t0, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS r0 FROM ri JOIN cc USING (tp)),
  rg AS (SELECT tp, t0, r0, coalesce(lead(t0) OVER w, first(t0) OVER w + 2 * pi()) AS t1, coalesce(lead(r0) OVER w, first(r0) OVER w) AS r1 FROM po WINDOW w AS (PARTITION BY tp ORDER BY t0)),
  gr AS (SELECT tp, (k + 36) % 36 AS k, r0 + (r1 - r0) * (k * pi() / 18 - t0) / (t1 - t0) AS e FROM rg, (SELECT unnest(range(-36, 73)) AS k) WHERE k * pi() / 18 >= t0 AND k * pi() / 18 < t1),
  pt AS (SELECT tp, pt, x - cx AS dx, y - cy AS dy, atan2(y - cy, x - cx) / (pi() / 18) AS i FROM de JOIN cc USING (tp)),
  wa AS (SELECT pt.*, g0.e + (g1.e - g0.e) * (i - floor(i)) AS e FROM pt JOIN gr g0 ON g0.tp = pt.tp AND g0.k = (floor(i) + 36) % 36 JOIN gr g1 ON g1.tp = pt.tp AND g1.k = (floor(i) + 37) % 36)
  SELECT tp, pt, {r('CASE WHEN sqrt(dx * dx + dy * dy) / e <= 1.2 THEN dx / e END AS x', 'CASE WHEN sqrt(dx * dx + dy * dy) / e <= 1.2 THEN dy / e END AS y')} FROM wa""")
def warped_points(spark, sf_dir):
    d = T.detections(spark, sf_dir)
    return mesh.warped(d, mesh.sector_rim(d, 12), 36, 1.2)


@query("longest_perimeter")
def longest_perimeter(spark, sf_dir):
    return mesh.longest_loop(mesh.loops(mesh.boundary(mesh.delaunay(T.detections(spark, sf_dir), 50.0))))


@query("alpha_outline")
def alpha_outline(spark, sf_dir):
    return mesh.alpha_shape(mesh.delaunay(T.detections(spark, sf_dir), 1000.0), 30.0)


@query("hull_points", f"""WITH {FRAMES}, u AS (SELECT tp, x, y, min(pt) AS pt FROM de GROUP BY tp, x, y), an AS (SELECT a.tp, a.pt, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS g FROM u a JOIN u b ON a.tp = b.tp AND a.pt <> b.pt),
  ga AS (SELECT *, g - lag(g) OVER (PARTITION BY tp, pt ORDER BY g) AS gap FROM an)
  SELECT tp, pt, {r('any_value(x) AS x', 'any_value(y) AS y')} FROM ga GROUP BY tp, pt HAVING greatest(coalesce(max(gap), 0), 2 * pi() - (max(g) - min(g))) > pi() + 1e-9""")
def hull_points(spark, sf_dir):
    return mesh.hull(T.detections(spark, sf_dir))
