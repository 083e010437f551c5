"""Registered queries of bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.operators import inference, reports, resampling
from fieldtrace.operators.groups import PERCENTILES
from fieldtrace.plans.catalogue import query, r
from fieldtrace.sources import tables as T

def _mixed(x: str, shift: int, factor: int | None) -> str:
    out = f"xor({x}, {x} >> {shift})"
    return out if factor is None else f"((({out})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def draws(source: str, keys: list[str], seed: str, boots: int = 1000) -> str:
    """CTEs up to ``dw``: (keys, v, n, b, w), weights of each distinct value of ``source`` (keys, v) and resample, 0 being the sample itself."""
    own = ", ".join(keys)
    return f"""dv AS (SELECT {own}, v, count(*) AS n, ('0x' || substr(md5('{seed}/' || {" || '/' || ".join(keys)} || '/' || v), 1, 15))::UHUGEINT AS k FROM ({source}) WHERE v IS NOT NULL GROUP BY {own}, v),
  dt AS (SELECT n, list(c ORDER BY k) AS t FROM (SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS c FROM (SELECT n, unnest(range(0, (n + 12 * sqrt(n) + 20)::BIGINT)) AS k FROM (SELECT DISTINCT n FROM dv))) GROUP BY n),
  d0 AS (SELECT {own}, v, n, b, ((k + b::UHUGEINT * {resampling.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM dv, (SELECT unnest(range(0, {boots + 1})) AS b)),
  d1 AS (SELECT * REPLACE ({_mixed('h', 30, resampling.FACTORS[0])} AS h) FROM d0), d2 AS (SELECT * REPLACE ({_mixed('h', 27, resampling.FACTORS[1])} AS h) FROM d1),
  dw AS (SELECT {own}, v, n, b, CASE WHEN b = 0 THEN n ELSE len(list_filter(t, lambda c: c <= ({_mixed('h', 31, None)} >> 11)::DOUBLE / 9007199254740992)) END AS w FROM d2 JOIN dt USING (n))"""


def intervals(keys: list[str]) -> str:
    """CTE ``iv``: (keys, size, mean and median with bounds) from ``dw``."""
    own = ", ".join(keys)
    bound = lambda c, q: f"CASE WHEN max(size) >= 3 THEN quantile_cont({c}, {q}) FILTER (b > 0) END"
    both = ", ".join(f"min({c}) FILTER (b = 0) AS {c}, {bound(c, 0.025)} AS {c}_lo, {bound(c, 0.975)} AS {c}_hi" for c in ("mean", "median"))
    return f"""dc AS (SELECT *, sum(w) OVER (PARTITION BY {own}, b ORDER BY v) AS c, sum(w) OVER (PARTITION BY {own}, b) AS t FROM dw),
  de AS (SELECT {own}, b, sum(n) AS size, sum(w * v) / sum(w) AS mean, (min(v) FILTER (c >= floor((t - 1) / 2) + 1) + min(v) FILTER (c >= ceil((t - 1) / 2) + 1)) / 2 AS median FROM dc WHERE t > 0 GROUP BY {own}, b),
  iv AS (SELECT {own}, max(size)::BIGINT AS size, {both} FROM de GROUP BY {own})"""


def _balances(spark, sf_dir):
    return T.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cond"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("v"))


BALANCES = "SELECT c_mktsegment AS cond, c_nationkey AS nation, c_acctbal::DOUBLE AS v FROM customer"


@query("bootstrap_interval", f"""WITH {draws('SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS v FROM lineitem', ['l_returnflag', 'l_linestatus'], '5')}, {intervals(['l_returnflag', 'l_linestatus'])}
  SELECT l_returnflag, l_linestatus, {r('mean', 'mean_lo AS lo', 'mean_hi AS hi')}, size AS n FROM iv""")
def bootstrap_interval(spark, sf_dir):
    return inference.bootstrap_interval(T.read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "5", 1000)


@query("bootstrap_medians", f"WITH {draws(BALANCES, ['cond'], '5')}, {intervals(['cond'])} SELECT cond, {r('median AS centre', 'median_lo AS lo', 'median_hi AS hi')}, size AS n FROM iv")
def bootstrap_medians(spark, sf_dir):
    return resampling.bootstrap(_balances(spark, sf_dir), ["cond"], "v", resampling.MEDIAN, "5")


@query("bootstrap_deviation", f"""WITH {draws(BALANCES, ['cond'], '6')}, de AS (SELECT cond, b, sum(n) AS size, sqrt(sum(w * v * v) / sum(w) - power(sum(w * v) / sum(w), 2)) AS s FROM dw GROUP BY cond, b HAVING sum(w) > 0)
  SELECT cond, {r('min(s) FILTER (b = 0) AS centre', 'quantile_cont(s, 0.05) FILTER (b > 0) AS lo', 'quantile_cont(s, 0.95) FILTER (b > 0) AS hi')}, max(size)::BIGINT AS n FROM de GROUP BY cond""")
def bootstrap_deviation(spark, sf_dir):
    return resampling.bootstrap(_balances(spark, sf_dir), ["cond"], "v", resampling.DEVIATION, "6", ci=0.9)


@query("summary_intervals", f"""WITH {draws(BALANCES, ['cond'], '0')}, {intervals(['cond'])}, q AS (SELECT cond, {', '.join(f'quantile_cont(v, {p}) AS p{round(p * 100):02d}' for p in PERCENTILES)}, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM ({BALANCES}) GROUP BY cond)
  SELECT cond, {r(*[f'p{round(p * 100):02d}' for p in PERCENTILES], 'q.mean AS mean', 'std', 'mean_lo', 'mean_hi', 'median_lo', 'median_hi', decimals=6)}, n FROM q JOIN iv USING (cond)""", 6)
def summary_intervals(spark, sf_dir):
    return reports.summary_intervals(_balances(spark, sf_dir), ["cond"], "v")


def _envelope(kind: str):
    return lambda spark, sf_dir: reports.envelope(_balances(spark, sf_dir), ["cond", "nation"], "v", kind)


for _name in ("mean", "median"):
    query(f"{_name}_envelope", f"WITH {draws(BALANCES, ['cond', 'nation'], '0')}, {intervals(['cond', 'nation'])} SELECT cond, nation, size AS n, {r(f'{_name} AS centre', f'{_name}_lo AS low', f'{_name}_hi AS high', decimals=6)} FROM iv", 6)(_envelope(f"{_name} ci"))


DAYS = "SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS week, user_id % 3 AS bin, value AS v FROM events"


@query("compartment_intervals", f"""WITH {draws(DAYS, ['week', 'bin'], '0', 200)}, {intervals(['week', 'bin'])}, q AS (SELECT week, bin, {', '.join(f'quantile_cont(v, {p}) AS p{round(p * 100):02d}' for p in PERCENTILES)}, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM ({DAYS}) GROUP BY week, bin)
  SELECT week, bin, {r(*[f'p{round(p * 100):02d}' for p in PERCENTILES], 'q.mean AS mean', 'std', 'n / sum(n) OVER (PARTITION BY week) AS support', 'mean_lo', 'mean_hi', 'median_lo', 'median_hi', decimals=6)}, n FROM q JOIN iv USING (week, bin)""", 6)
def compartment_intervals(spark, sf_dir):
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    rows = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), week.alias("week"), F.col("value").alias("v"))
    members = rows.select("track").distinct().withColumn("bin", F.col("track") % 3)
    return reports.compartment_intervals(members, rows, "track", "week", "v", 3, boots=200)
