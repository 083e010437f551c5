"""Registered queries of comparisons within groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import comparisons
from fieldtrace.plans.catalogue import query, r, student_sql
from fieldtrace.plans.inference import NORMAL
from fieldtrace.sources import tables as T

ROWS = "ro AS (SELECT l_returnflag AS g, o_orderpriority || '/' || l_linestatus AS level, l_extendedprice::DOUBLE AS v, l_linestatus AS s, o_orderpriority AS pr FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
HOLM = "k AS (SELECT *, row_number() OVER (ORDER BY p, \"group\", level1, level2) AS k, count(*) OVER () AS m FROM te), ho AS (SELECT *, least(1, max((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS adjusted FROM k)"


def _rows(spark, sf_dir):
    lines, orders = T.read(spark, sf_dir, "lineitem"), T.read(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", "l_linestatus", "o_orderpriority", F.col("l_extendedprice").cast("double").alias("v"))


@query("compared_groups", f"""WITH {ROWS}, lv AS (SELECT g, level, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM ro GROUP BY ALL HAVING count(*) > 1),
  tt AS (SELECT a.g AS "group", a.level AS level1, b.level AS level2, (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS t, power(a.s / a.n + b.s / b.n, 2) / (power(a.s / a.n, 2) / (a.n - 1) + power(b.s / b.n, 2) / (b.n - 1)) AS df FROM lv a JOIN lv b ON a.g = b.g AND a.level < b.level),
  te AS (SELECT "group", level1, level2, {student_sql('t', 'df')} AS p FROM tt), {HOLM} SELECT "group", level1, level2, {r('p', 'adjusted', decimals=5)} FROM ho""", 5)
def compared_groups(spark, sf_dir):
    return comparisons.compared(_rows(spark, sf_dir), ["o_orderpriority", "l_linestatus"], "v", "welch-t-test", group=["l_returnflag"], keep_all=True)


@query("compared_ranks", f"""WITH {ROWS}, lv AS (SELECT DISTINCT g, pr FROM ro), un AS (SELECT a.g, a.pr AS level1, b.pr AS level2, v, ro.pr = a.pr AS mine FROM lv a JOIN lv b ON a.g = b.g AND a.pr < b.pr JOIN ro ON ro.g = a.g AND ro.pr IN (a.pr, b.pr) WHERE '1-URGENT' IN (a.pr, b.pr)),
  rk AS (SELECT *, rank() OVER (PARTITION BY g, level1, level2 ORDER BY v) + (count(*) OVER (PARTITION BY g, level1, level2, v) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY g, level1, level2, v) AS t FROM un),
  rs AS (SELECT g, level1, level2, count(*) FILTER (mine) AS n1, count(*) FILTER (NOT mine) AS n2, sum(k) FILTER (mine) AS s, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY ALL),
  zz AS (SELECT g AS "group", level1, level2, (abs(s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z FROM rs),
  te AS (SELECT "group", level1, level2, {NORMAL} AS p FROM zz), {HOLM} SELECT "group", level1, level2, {r('p', 'adjusted', decimals=5)} FROM ho""", 5)
def compared_ranks(spark, sf_dir):
    return comparisons.compared(_rows(spark, sf_dir), ["o_orderpriority"], "v", "u-test", group=["l_returnflag"], control=["1-URGENT"], keep_all=True)


@query("comparison_report", f"""WITH {ROWS}, re AS (SELECT * FROM ro WHERE g IN ('R', 'N') AND s = 'O'), lv AS (SELECT pr AS level, count(*) AS n, avg(v) AS m, var_samp(v) AS s, stddev_pop(v) AS d FROM re GROUP BY pr),
  tt AS (SELECT '' AS "group", a.level AS level1, b.level AS level2, (a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t, a.n + b.n - 2 AS df FROM lv a JOIN lv b ON a.level < b.level WHERE a.n > 1 AND b.n > 1),
  te AS (SELECT "group", level1, level2, {student_sql('t', 'df')} AS p FROM tt), {HOLM}
  SELECT level, {r('m AS mean', 'd AS std')}, n, (SELECT count(*) FROM ho WHERE adjusted <= 0.6 AND (level1 = level OR level2 = level)) AS differs FROM lv""")
def comparison_report(spark, sf_dir):
    return comparisons.comparison_report(_rows(spark, sf_dir), {"l_returnflag": ["R", "N"], "l_linestatus": ["O"]}, "o_orderpriority", "v", alpha=0.6)
