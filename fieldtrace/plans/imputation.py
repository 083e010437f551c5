"""Registered queries of made points and of frames linked anew."""

from __future__ import annotations

from fieldtrace.operators import imputation
from fieldtrace.plans.catalogue import RADIUS, query, r
from fieldtrace.plans.meshes import NEAR, _graph
from fieldtrace.sources import tables as T

MADE = NEAR + """, sz AS (SELECT tp FROM de GROUP BY tp HAVING count(*) >= 10), wh AS (SELECT tp FROM sz WHERE tp + 1 IN (SELECT tp FROM sz)), mw AS (SELECT * FROM mo WHERE tp IN (SELECT tp FROM wh)),
  fo AS (SELECT bo.tp, bo.pt, avg(x2 - x1) AS dx, avg(y2 - y1) AS dy, count(*) AS n FROM bo JOIN mw ON mw.tp = bo.tp AND mw.pt1 = bo.near GROUP BY bo.tp, bo.pt HAVING count(*) >= 3),
  ba AS (SELECT bo.tp - 1 AS tp, bo.pt, avg(x1 - x2) AS dx, avg(y1 - y2) AS dy, count(*) AS n FROM bo JOIN mw ON mw.tp = bo.tp - 1 AND mw.pt2 = bo.near GROUP BY bo.tp, bo.pt HAVING count(*) >= 3),
  ma AS (SELECT d.tp + 1 AS tp, TRUE AS forward, d.pt AS source, x + dx AS x, y + dy AS y, n FROM de d JOIN fo ON fo.tp = d.tp AND fo.pt = d.pt WHERE (d.tp, d.pt) NOT IN (SELECT (tp, pt1) FROM ne)
    UNION ALL SELECT d.tp - 1, FALSE, d.pt, x + dx, y + dy, n FROM de d JOIN ba ON ba.tp = d.tp - 1 AND ba.pt = d.pt WHERE (d.tp - 1, d.pt) NOT IN (SELECT (tp, pt2) FROM ne))"""


@query("made_points", f"WITH {MADE} SELECT tp, forward, source, {r('x', 'y', decimals=6)}, n FROM ma", 6)
def made_points(spark, sf_dir):
    points, _, links = _graph(spark, sf_dir)
    return imputation.made_points(points, RADIUS, links)


@query("merged_frames", f"""WITH {MADE}, fr AS (SELECT DISTINCT tp FROM de), bt AS (SELECT tp FROM fr WHERE tp - 1 IN (SELECT tp FROM fr) AND tp + 1 IN (SELECT tp FROM fr)),
  vs AS (SELECT tp, unnest([0, 1]) AS v, 0 AS k, pt AS s, x, y FROM de UNION ALL SELECT tp, CASE WHEN forward THEN 0 ELSE 1 END, 1, source, x, y FROM ma),
  hd AS (SELECT b.tp, b.v, b.k, b.s, any_value(b.x) AS x, any_value(b.y) AS y, min({{'v': a.v, 'k': a.k, 's': a.s}}) AS h FROM vs a JOIN vs b ON a.tp = b.tp AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 WHERE a.tp IN (SELECT tp FROM bt) AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2 GROUP BY b.tp, b.v, b.k, b.s)
  SELECT tp, {r('avg(x) AS x', 'avg(y) AS y', decimals=6)}, count(*) AS n FROM hd GROUP BY tp, h UNION ALL
  SELECT tp, round(x, 6), round(y, 6), 1 FROM vs WHERE tp NOT IN (SELECT tp FROM bt) AND ((v = 0 AND tp - 1 IN (SELECT tp FROM fr)) OR (v = 1 AND tp + 1 IN (SELECT tp FROM fr))) UNION ALL
  SELECT tp, round(x, 6), round(y, 6), 1 FROM de WHERE tp - 1 NOT IN (SELECT tp FROM fr) AND tp + 1 NOT IN (SELECT tp FROM fr)""", 6)
def merged_frames(spark, sf_dir):
    points, _, links = _graph(spark, sf_dir)
    return imputation.merged_frames(points, imputation.made_points(points, RADIUS, links)).drop("pt")


@query("relinked_tracks")
def relinked_tracks(spark, sf_dir):
    return imputation.linked_with_made(T.detections(spark, sf_dir), "nearest", RADIUS, edges=imputation.within, reach=RADIUS)[1]
