"""Registered queries of rank tests, corrections, resampling and linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import groups, inference
from fieldtrace.plans.catalogue import LEVELS, TRUTH, query, r
from fieldtrace.sources import tables as T

RANKS = LEVELS + """, un AS (SELECT a.cond AS level1, b.cond AS level2, ob.score, ob.cond = a.cond AS mine FROM lv a JOIN lv b ON a.cond < b.cond JOIN ob ON ob.cond IN (a.cond, b.cond)),
  rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY level1, level2, score) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY level1, level2, score) AS t,
    count(*) FILTER (mine) OVER w AS c1, count(*) FILTER (NOT mine) OVER w AS c2 FROM un WINDOW w AS (PARTITION BY level1, level2 ORDER BY score)),
  rs AS (SELECT level1, level2, count(*) FILTER (mine) AS n1, count(*) FILTER (NOT mine) AS n2, sum(k) FILTER (mine) AS s, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY ALL),
  ru AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, (n1 + n2)::DOUBLE AS n FROM rs),
  rg AS (SELECT level1, level2, max(abs(c1 / n1 - c2 / n2)) AS gap FROM rk JOIN rs USING (level1, level2) GROUP BY ALL)"""


def _priced(spark, sf_dir):
    lines, orders = T.read(spark, sf_dir, "lineitem"), T.read(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("batch"), "l_extendedprice")


@query("rank_tests", f"""WITH {RANKS} SELECT level1, level2, n1, n2, {r('u', '(abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z', 'gap', decimals=5)} FROM ru JOIN rg USING (level1, level2)""", 5)
def rank_tests(spark, sf_dir):
    return inference.rank_tests(_priced(spark, sf_dir), "o_orderpriority", "l_extendedprice")


#: Two-sided p-value of a normal, its density summed by Simpson's rule.
NORMAL = "greatest(0, 1 - 2 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(k * z / 4000, 2) / 2))) * z / 12000)"
GAP = "CASE WHEN gap * gap * n1 * n2 / (n1 + n2) < 0.04 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * gap * gap * n1 * n2 / (n1 + n2) * k * k))))) END"


@query("rank_significance", f"""WITH {RANKS}, zz AS (SELECT level1, level2, n1, n2, u, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z, gap FROM ru JOIN rg USING (level1, level2))
  SELECT level1, level2, n1, n2, {r('u', 'z', 'gap', f'{NORMAL} AS p_rank', f'{GAP} AS p_gap', decimals=6)} FROM zz""", 6)
def rank_significance(spark, sf_dir):
    tests = inference.rank_tests(_priced(spark, sf_dir), "o_orderpriority", "l_extendedprice")
    return tests.withColumn("p_rank", inference.normal_p("z")).withColumn("p_gap", inference.kolmogorov_p(F.col("gap"), F.col("n1"), F.col("n2")))


@query("corrected_tests", f"""WITH {LEVELS}, te AS (SELECT a.cond AS level1, b.cond AS level2, exp(-abs((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n))) AS p FROM lv a JOIN lv b ON a.cond < b.cond),
  k AS (SELECT *, row_number() OVER (ORDER BY p, level1, level2) AS k, count(*) OVER () AS m FROM te)
  SELECT level1, level2, {r('p', 'least(1, m * p) AS bonferroni', 'least(1, 1 - power(1 - p, m)) AS sidak', 'least(1, max((m - k + 1) * p) OVER a) AS holm', 'least(1, max(1 - power(1 - p, m - k + 1)) OVER a) AS holm_sidak',
  'least(1, min(p * m / k) OVER z) AS benjamini_hochberg', 'least(1, min(p * m / k * list_sum([1 / i FOR i IN range(1, m + 1)])) OVER z) AS benjamini_yekutieli', decimals=5)}
  FROM k WINDOW a AS (ORDER BY k ROWS UNBOUNDED PRECEDING), z AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", 5)
def corrected_tests(spark, sf_dir):
    tests = groups.pairwise_t(_priced(spark, sf_dir), "o_orderpriority", "l_extendedprice").select("level1", "level2", F.exp(-F.abs("t")).alias("p"))
    return inference.corrected(tests, "p", ["level1", "level2"], ["bonferroni", "sidak", "holm", "holm_sidak", "benjamini_hochberg", "benjamini_yekutieli"])


@query("precision_summary", f"""WITH {TRUTH}, c AS (SELECT score, tp / np AS tpr, tp / (tp + fp) AS pr FROM cu), a AS (SELECT *, lag(tpr, 1, 0) OVER w AS t0, lag(pr, 1, 1) OVER w AS p0 FROM c WINDOW w AS (ORDER BY score DESC))
  SELECT round(sum((tpr - t0) * (pr + p0) / 2), 4) AS auc, round((SELECT score FROM c ORDER BY round(tpr * tpr + pr * pr, 9) DESC, score DESC LIMIT 1), 4) AS knee FROM a""")
def precision_summary(spark, sf_dir):
    return inference.precision_summary(groups.score_curve(T.scored_truth(spark, sf_dir)))


@query("bootstrap_bounds", f"""WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity, b, ('0x' || substr(md5('5/' || b || '/' || l_orderkey || '/' || l_linenumber), 1, 8))::BIGINT / 4294967296 AS u FROM lineitem, (SELECT unnest(range(1, 21)) AS b)),
  w AS (SELECT *, {' + '.join(f'CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END' for p in inference.POISSON)} AS w FROM d), m AS (SELECT l_returnflag, l_linestatus, b, sum(w * l_quantity) / sum(w) AS s, avg(l_quantity) AS a, count(*) AS n FROM w GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, {r('min(a) AS mean', 'CASE WHEN max(n) >= 3 THEN quantile_cont(s, 0.025) END AS lo', 'CASE WHEN max(n) >= 3 THEN quantile_cont(s, 0.975) END AS hi')}, max(n) AS n FROM m GROUP BY ALL""")
def bootstrap_bounds(spark, sf_dir):
    return inference.bootstrap_bounds(T.read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"], "l_quantity", "5", 20)


@query("variance_table")
def variance_table(spark, sf_dir):
    return inference.variance_table(_priced(spark, sf_dir), ["o_orderpriority", "l_returnflag"], "l_extendedprice", interactions=True)


@query("batch_effect", f"""WITH RECURSIVE pr AS (SELECT l_returnflag AS f, year(l_shipdate) AS b, l_extendedprice::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  ce AS (SELECT f, b, dense_rank() OVER (ORDER BY f) AS i, dense_rank() OVER (ORDER BY b) AS j, count(*) AS n, avg(v) AS m FROM pr GROUP BY f, b),
  it AS (SELECT 0 AS k, (SELECT list(0.0::DOUBLE) FROM (SELECT DISTINCT j FROM ce)) AS o UNION ALL
    SELECT k + 1, list(v ORDER BY j) FROM (SELECT any_value(k) AS k, c.j, sum(c.n * (c.m - a.a)) / sum(c.n) AS v FROM ce c JOIN (SELECT any_value(k) AS k, i, sum(n * (m - o[j])) / sum(n) AS a FROM it, ce WHERE k < 3000 GROUP BY i) a ON a.i = c.i GROUP BY c.j) GROUP BY k)
  SELECT f AS l_returnflag, b AS batch, {r('m AS mean', 'm - (o[j] - list_avg(o)) AS adjusted')} FROM ce, (SELECT o FROM it ORDER BY k DESC LIMIT 1)""")
def batch_effect(spark, sf_dir):
    rows = inference.without_batch_effect(_priced(spark, sf_dir), "l_returnflag", ["batch"], "l_extendedprice")
    return rows.groupBy("l_returnflag", "batch").agg(F.avg("l_extendedprice").alias("mean"), F.avg("adjusted").alias("adjusted"))


@query("pairwise_power")
def pairwise_power(spark, sf_dir):
    return inference.pairwise_power(_priced(spark, sf_dir), "o_orderpriority", "l_extendedprice")


@query("tested_pairs", f"""WITH {LEVELS}, te AS (SELECT a.cond AS level1, b.cond AS level2, exp(-abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)) AS p,
    abs(a.m - b.m) / sqrt(((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) / (a.n + b.n)) AS effect FROM lv a JOIN lv b ON a.cond < b.cond),
  k AS (SELECT *, row_number() OVER (ORDER BY p, level1, level2) AS k, count(*) OVER () AS m FROM te)
  SELECT level1, level2, {r('p', 'effect', 'least(1, max((m - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS adjusted', decimals=5)} FROM k""", 5)
def tested_pairs(spark, sf_dir):
    test = lambda n1, m1, v1, n2, m2, v2: F.exp(-F.abs(m1 - m2) / F.sqrt(v1 / n1 + v2 / n2))
    return groups.tested(_priced(spark, sf_dir), "o_orderpriority", "l_extendedprice", test)
