"""Registered queries of the persistence chain, track parameters and radial significance."""

from __future__ import annotations

from fieldtrace.operators import persistence
from fieldtrace.operators.written import written
from fieldtrace.plans.catalogue import POINTS, query, r
from fieldtrace.sources import tables as T

#: Degrees a minute under which a heading is persistent here; points of these tracks are hours apart.
CUTOFF = 0.02
CHAIN = POINTS + f""", wi AS (SELECT *, regr_slope(x, t) OVER w AS sx, regr_intercept(x, t) OVER w AS ix, regr_slope(y, t) OVER w AS sy, regr_intercept(y, t) OVER w AS iy, count(*) OVER w AS k, count(*) OVER v AS n, min(t) OVER v AS t0, (max(t) OVER v - min(t) OVER v) / (count(*) OVER v * 4 - 1) AS step
  FROM tp WINDOW v AS (PARTITION BY track), w AS (PARTITION BY track ORDER BY tp ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  ti AS (SELECT track, n, unnest(range(n * 4)) AS place, t0, step FROM (SELECT DISTINCT track, n, t0, step FROM wi) WHERE step > 0),
  own AS (SELECT ti.track, place, t0 + place * step AS t, CASE WHEN place = n * 4 - 1 THEN n - 1 ELSE (SELECT max(p.tp) FROM tp p WHERE p.track = ti.track AND ceil((p.t - t0) / step) <= place) END AS own, n FROM ti),
  ev AS (SELECT o.track, place, o.t, ix + sx * o.t AS x, iy + sy * o.t AS y, o.n * 4 AS m FROM own o JOIN wi ON wi.track = o.track AND wi.k = 7 AND wi.tp = least(greatest(o.own, 3), o.n - 4)),
  ro AS (SELECT a.track, a.place, any_value(a.t) AS t, avg(b.x) AS x, avg(b.y) AS y FROM (SELECT track, place, t, m, unnest(range(place - 10, place + 10)) AS k FROM ev) a JOIN ev b ON b.track = a.track AND b.place = greatest(0, least(a.m - 1, a.k)) GROUP BY a.track, a.place),
  ve AS (SELECT *, lead(t) OVER w - t AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ro WINDOW w AS (PARTITION BY track ORDER BY place)),
  he AS (SELECT *, sqrt(dx * dx + dy * dy) AS ds, atan2(dy, dx) AS h FROM ve WHERE dt IS NOT NULL), tu AS (SELECT *, coalesce(round((h - lag(h) OVER w) / (2 * pi())), 0) AS k FROM he WINDOW w AS (PARTITION BY track ORDER BY place)),
  un AS (SELECT *, degrees(h - 2 * pi() * sum(k) OVER (PARTITION BY track ORDER BY place)) AS angle, count(*) OVER (PARTITION BY track) AS m FROM tu),
  s0 AS (SELECT *, regr_slope(angle, t) OVER w AS own, count(*) OVER w AS c FROM un WINDOW w AS (PARTITION BY track ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  s1 AS (SELECT a.track, a.place, b.own AS slope FROM s0 a JOIN s0 b ON b.track = a.track AND b.c = 7 AND b.place = least(greatest(a.place, 3), a.m - 4)),
  f0 AS (SELECT track, place, abs(slope) < {CUTOFF} AS flat, min(CASE WHEN abs(slope) < {CUTOFF} THEN 1 ELSE 0 END) OVER (PARTITION BY track) AS whole FROM s1),
  r0 AS (SELECT *, place - row_number() OVER (PARTITION BY track, flat ORDER BY place) AS run FROM f0),
  f1 AS (SELECT track, place, whole, CASE WHEN flat AND whole = 0 AND count(*) OVER (PARTITION BY track, flat, run) < 5 THEN FALSE ELSE flat END AS flat FROM r0),
  r1 AS (SELECT *, place - row_number() OVER (PARTITION BY track, flat ORDER BY place) AS run FROM f1),
  f2 AS (SELECT track, place, CASE WHEN NOT flat AND max(CASE WHEN flat THEN 1 ELSE 0 END) OVER (PARTITION BY track) = 1 AND count(*) OVER (PARTITION BY track, flat, run) < 5 THEN TRUE ELSE flat END AS flat FROM r1),
  r2 AS (SELECT *, place - row_number() OVER (PARTITION BY track, flat ORDER BY place) AS run FROM f2),
  fr AS (SELECT track, min(place) AS start, max(place) AS stop, count(*) AS n FROM r2 WHERE flat GROUP BY track, run)"""


def _chain(spark, sf_dir):
    return persistence.timeline(T.track_points(spark, sf_dir), cutoff=CUTOFF)


@query("track_persistence", f"""WITH {CHAIN}, il AS (SELECT fr.track, start, stop, sum(dt) AS duration, sum(ds) AS distance, sqrt(power(max_by(x, place) - min_by(x, place), 2) + power(max_by(y, place) - min_by(y, place), 2)) AS displacement, avg(CASE WHEN dt > 0 THEN ds / dt END) AS speed, min(t) AS b, max(t) AS e
  FROM fr JOIN he ON he.track = fr.track AND he.place BETWEEN start AND stop GROUP BY fr.track, start, stop)
  SELECT track, start, stop, {r('duration', 'distance', 'displacement', 'speed', 'b - lag(e) OVER (PARTITION BY track ORDER BY start) AS gap', decimals=3)} FROM il""", 3)
def track_persistence(spark, sf_dir):
    chain = written(_chain(spark, sf_dir))
    return persistence.islands(chain, persistence.stretches(chain))


WAVE = CHAIN + """, wf AS (SELECT ro.track, ro.place, ro.t, fr.track IS NOT NULL AS persistent, CASE WHEN fr.track IS NOT NULL THEN ds / dt END AS wave FROM ro LEFT JOIN fr ON fr.track = ro.track AND ro.place >= start AND ro.place < stop LEFT JOIN he ON he.track = ro.track AND he.place = ro.place)"""


@query("persistence_waveform", f"WITH {WAVE} SELECT track, place AS tp, {r('t', 'wave AS waveform', decimals=3)}, persistent FROM wf", 3)
def persistence_waveform(spark, sf_dir):
    return persistence.waveform(_chain(spark, sf_dir))


@query("persistence_at", f"WITH {WAVE} SELECT track, {r('avg(persistent::INTEGER) AS persistent', '1 - avg(persistent::INTEGER) AS quiescent')} FROM wf WHERE t >= 7200 AND t < 14400 GROUP BY track")
def persistence_at(spark, sf_dir):
    return persistence.persistence_at(_chain(spark, sf_dir), 7200.0, 7200.0)


@query("sampled_waveform", f"WITH {WAVE}, tm AS (SELECT track, unnest([0.0, 10000.0, 20000.0, 30000.0]::DOUBLE[]) AS \"time\" FROM (SELECT DISTINCT track FROM ro)) SELECT tm.track, tm.\"time\", round(avg(wave), 4) AS waveform FROM tm LEFT JOIN wf ON wf.track = tm.track AND wf.persistent AND t >= tm.\"time\" AND t < tm.\"time\" + 10000 AND tm.\"time\" < 30000 GROUP BY ALL")
def sampled_waveform(spark, sf_dir):
    return persistence.sampled_waveform(_chain(spark, sf_dir), [0.0, 10000.0, 20000.0, 30000.0])
