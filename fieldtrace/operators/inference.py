"""Rank tests, corrections, curves, resampling and linear models over observations."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, resampling
from .groups import _beta_fraction, level_pairs, moments, running_totals, student_p
from .written import written


#: Most levels of a category whose pairs are tested; most combinations of levels that a linear model is fitted on.
LEVELS, CELLS = 1000, 100_000


def level_names(rows: DataFrame, category: str) -> list:
    """Distinct levels in order; more than ``LEVELS`` are an error, as every pair of them is a row."""
    names = [row[0] for row in rows.select(category).filter(F.col(category).isNotNull()).distinct().limit(LEVELS + 1).collect()]
    if len(names) > LEVELS:
        raise ValueError(f"more than {LEVELS} levels of {category}")
    return sorted(names)


def rank_tests(rows: DataFrame, category: str, score: str, wanted: Callable[[str, str], bool] | None = None) -> DataFrame:
    """level1, level2, n1, n2, u, z (continuity and ties corrected) and gap (greatest distance of the distributions) of each two levels, or of the pairs ``wanted``.

    Rows are first counted per score and level, then summed along the scores once for all levels; no pair's rows meet in one task.
    """
    names = level_names(rows, category)
    own = lambda i: F.sum(F.when(F.col(category) == F.lit(names[i]), 1).otherwise(0))
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if wanted is None or wanted(names[i], names[j])]
    if not pairs:
        names, pairs = [None, None], [(0, 1)]
    counts = rows.filter(F.col(score).isNotNull()).groupBy(score).agg(*[own(i).alias(f"n{i}") for i in range(len(names))])
    counts = written(counts.select("*", *[F.col(f"n{i}").alias(f"c{i}") for i in range(len(names))]))
    ends = counts.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(names))])
    table = running_totals(counts, score, [f"c{i}" for i in range(len(names))]).join(F.broadcast(ends), F.lit(True))
    pair = lambda i, j: F.struct(F.lit(names[i]).alias("level1"), F.lit(names[j]).alias("level2"), *[F.col(f"{c}{k}").alias(f"{c}{m}") for m, k in ((1, i), (2, j)) for c in "nct"])
    each = table.select(F.explode(F.array(*[pair(i, j) for i, j in pairs])).alias("p")).select("p.*").filter("t1 > 1 and t2 > 1")
    n = F.col("n1") + F.col("n2")
    sums = each.groupBy("level1", "level2", F.col("t1").alias("m1"), F.col("t2").alias("m2")).agg(
        F.sum(F.col("n1") * (F.col("t2") - F.col("c2") + F.col("n2") / 2)).alias("u"),
        F.sum(F.pow(n.cast("double"), 3) - n).alias("ties"),
        F.max(F.abs(F.col("c1") / F.col("t1") - F.col("c2") / F.col("t2"))).alias("gap"),
    )
    a, b = F.col("m1").cast("double"), F.col("m2").cast("double")
    deviation = F.sqrt(a * b / 12 * (a + b + 1 - F.col("ties") / ((a + b) * (a + b - 1))))
    z = F.when(deviation > 0, (F.abs(F.col("u") - a * b / 2) - 0.5) / deviation)
    return sums.select("level1", "level2", F.col("m1").alias("n1"), F.col("m2").alias("n2"), "u", z.alias("z"), "gap")


def normal_p(z: str) -> Column:
    """Two-sided normal p-values, one row per pair of levels."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else min(1.0, math.erfc(v / math.sqrt(2))) for v in z], dtype=float)

    return p(z)


def kolmogorov_p(gap: Column, n1: Column, n2: Column) -> Column:
    """Limit p-value of the two-sample Kolmogorov-Smirnov gap."""
    x = -2 * gap * gap * n1 * n2 / (n1 + n2)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1).otherwise(-1) * F.exp(x * k * k))
    return F.when(gap * gap * n1 * n2 / (n1 + n2) < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms)))


def corrected(tests: DataFrame, p: str, keys: list[str], methods: list[str]) -> DataFrame:
    """Adds a column per method: bonferroni, sidak, holm, holm_sidak, benjamini_hochberg, benjamini_yekutieli. The table has one row per pair of levels."""
    up = Window.orderBy(p, *keys)
    so_far, rest = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    rows = tests.withColumn("_k", F.row_number().over(up)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    v, k, m = F.col(p), F.col("_k"), F.col("_m")
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("long"), m), F.lit(0.0), lambda s, i: s + 1 / i)
    rules = {
        "bonferroni": m * v,
        "sidak": 1 - F.pow(1 - v, m),
        "holm": F.max((m - k + 1) * v).over(so_far),
        "holm_sidak": F.max(1 - F.pow(1 - v, m - k + 1)).over(so_far),
        "benjamini_hochberg": F.min(v * m / k).over(rest),
        "benjamini_yekutieli": F.min(v * m / k * harmonic).over(rest),
    }
    return rows.select("*", *[F.least(F.lit(1.0), rules[name]).alias(name) for name in methods]).drop("_k", "_m")


def precision_summary(curve: DataFrame) -> DataFrame:
    """auc of precision over recall by trapezoids from (0, 1), and the score where precision² + recall² is greatest."""
    x0, y0 = F.coalesce("before_tpr", F.lit(0.0)), F.coalesce("before_precision", F.lit(1.0))
    area = (F.col("tpr") - x0) * (F.col("precision") + y0) / 2
    return ranks.previous(curve, "score", ["tpr", "precision"]).withColumn("area", area).agg(F.sum("area").alias("auc"), F.max_by("score", F.struct(F.round(F.pow("tpr", 2) + F.pow("precision", 2), 9), "score")).alias("knee"))


#: Cumulative Poisson(1) probabilities up to 12 draws.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def bootstrap_bounds(rows: DataFrame, by: list[str], key: list[str], score: str, seed: str, boots: int, ci: float = 0.95) -> DataFrame:
    """Mean, n and bounds of the mean in each group, from ``boots`` resamples; below three values there are no bounds.

    A row's weight in a resample is a Poisson draw from the hash of (seed, resample, key): reruns agree, and resamples
    are partial sums on the map side, so one row per group and resample is shuffled.
    """
    rows = rows.filter(F.col(score).isNotNull())
    text = F.concat_ws("/", F.lit(seed), F.col("boot").cast("string"), *[F.col(c).cast("string") for c in key])
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32
    weight = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), start=F.lit(0))
    drawn = rows.select(*by, *key, score, F.explode(F.sequence(F.lit(1), F.lit(boots))).alias("boot")).withColumn("u", u).withColumn("w", weight)
    means = drawn.groupBy(*by, "boot").agg(F.sum(F.col("w") * F.col(score)).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"), F.avg(score).alias("mean"))
    bound = lambda q: F.percentile(F.when((F.col("w") > 0) & (F.col("n") >= 3), F.col("s") / F.col("w")), q)
    return means.groupBy(*by).agg(F.min_by("mean", "boot").alias("mean"), bound((1 - ci) / 2).alias("lo"), bound((1 + ci) / 2).alias("hi"), F.max("n").alias("n"))


def bootstrap_interval(rows: DataFrame, by: list[str], score: str, seed: str, boots: int, ci: float = 0.95) -> DataFrame:
    """Mean, n and bounds of the mean of each group as ``resampling.bootstrap`` draws them, with one draw for all equal scores of a group."""
    return resampling.bootstrap(rows, by, score, resampling.MEAN, seed, boots, ci).withColumnRenamed("centre", "mean")


def _dummies(values: pd.Series) -> np.ndarray:
    return (values.to_numpy()[:, None] == np.array(sorted(values.unique()))[None]).astype(float)


def _cells(rows: DataFrame, factors: list[str], score: str) -> pd.DataFrame:
    """n, mean and sum of squares around it for each combination of levels, the only rows that leave Spark; more than ``CELLS`` are an error."""
    kept = rows.dropna(subset=[*factors, score])
    cells = kept.groupBy(*factors).agg(F.count("*").alias("n"), F.avg(score).alias("m"), (F.var_pop(score) * F.count("*")).alias("q"))
    cells = cells.limit(CELLS + 1).toPandas()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} combinations of {factors}")
    return cells.sort_values(factors, ignore_index=True)


def fisher_p(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if not f > 0 or d1 <= 0 or d2 <= 0:
        return float("nan")
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def variance_table(rows: DataFrame, factors: list[str], score: str, interactions: bool = False) -> DataFrame:
    """Analysis of variance with sequential sums of squares: term, df, ss, ms, f, p, the residual last. Models are fitted on the cells."""
    cells = _cells(rows, factors, score)
    w, y = np.sqrt(cells["n"].to_numpy(float)), cells["m"].to_numpy(float)
    parts = {c: _dummies(cells[c]) for c in factors}
    terms = list(factors) + ([f"{a}:{b}" for a, b in combinations(factors, 2)] if interactions else [])
    design, out, before, rank = np.ones((len(cells), 1)), [], None, 0
    for term in [None, *terms]:
        if term is not None:
            names = term.split(":") if term not in parts else [term]
            block = parts[names[0]] if len(names) == 1 else np.einsum("ij,ik->ijk", parts[names[0]], parts[names[1]]).reshape(len(cells), -1)
            design = np.hstack([design, block])
        beta, _, r, _ = np.linalg.lstsq(design * w[:, None], y * w, rcond=None)
        left = float(((y * w - design @ beta * w) ** 2).sum())
        if term is not None:
            out.append((term, int(r - rank), max(0.0, before - left)))
        before, rank = left, r
    ss, df = before + float(cells["q"].sum()), int(cells["n"].sum() - rank)
    table = [(t, d, s, s / d if d else None, s / d / (ss / df) if d and df and ss else None, fisher_p(s / d / (ss / df), d, df) if d and df and ss else None) for t, d, s in out]
    table.append(("residual", df, ss, ss / df if df else None, None, None))
    return rows.sparkSession.createDataFrame(table, "term string, df int, ss double, ms double, f double, p double")


def without_batch_effect(rows: DataFrame, category: str, batches: list[str], score: str) -> DataFrame:
    """Column ``adjusted``: the score less its batch levels' offsets, which have mean 0 in each batch column.

    Least squares on category and batches without an intercept, from the cells; batch columns with one level are left out.
    Rows with a null among these columns keep a null ``adjusted``.
    """
    spark, cells = rows.sparkSession, _cells(rows, [category, *batches], score)
    used = [b for b in batches if cells[b].nunique() > 1]
    w = np.sqrt(cells["n"].to_numpy(float))[:, None]
    blocks = [_dummies(cells[c]) for c in [category, *used]]
    beta = np.linalg.lstsq(np.hstack(blocks) * w, cells["m"].to_numpy(float) * w[:, 0], rcond=None)[0] if len(cells) else np.zeros(0)
    out, shift, at = rows, F.lit(0.0), blocks[0].shape[1]
    for b, block in zip(used, blocks[1:], strict=True):
        part = beta[at : at + block.shape[1]]
        at += block.shape[1]
        offsets = pd.DataFrame({b: sorted(cells[b].unique()), f"_{b}": part - part.mean()})
        kinds = f"{b} {dict(rows.dtypes)[b]}, _{b} double"
        out = out.join(F.broadcast(spark.createDataFrame(offsets, kinds)), b, "left")
        shift = shift + F.col(f"_{b}")
    return out.withColumn("adjusted", F.when(F.col(category).isNotNull(), F.col(score) - shift)).drop(*[f"_{b}" for b in used])


def _t_power(effect: float, n1: float, n2: float, alpha: float) -> float:
    """Power of the two-sided t-test: the noncentral t is a normal over a chi, whose values are summed on a fine grid."""
    df, shift = n1 + n2 - 2, effect * math.sqrt(n1 * n2 / (n1 + n2))
    low, high = 0.0, 1e7
    for _ in range(100):
        cut = (low + high) / 2
        low, high = (cut, high) if student_p(cut, df) > alpha else (low, cut)
    spread = 9 / math.sqrt(2 * df)
    s = np.linspace(max(1e-9, 1 - spread), 1 + spread, 1501)
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    weight = np.exp(log)
    tail = np.array([math.erfc((cut * v - shift) / math.sqrt(2)) + math.erfc((cut * v + shift) / math.sqrt(2)) for v in s]) / 2
    return float((weight * tail).sum() / weight.sum())


def needed_samples(effect: float, power: float = 0.8, alpha: float = 0.05, ratio: float = 1.0) -> float:
    """Size of the first of two samples, the second ``ratio`` times as large, for a two-sided t-test of that power; NaN without an effect."""
    if not effect > 0:
        return float("nan")
    low, high = math.log(2.001 / min(1.0, ratio) / 2 + 0.5), math.log(1e12)
    if _t_power(effect, math.exp(low), math.exp(low) * ratio, alpha) >= power:
        return math.exp(low)
    for _ in range(50):
        middle = (low + high) / 2
        n = math.exp(middle)
        low, high = (middle, high) if _t_power(effect, n, n * ratio, alpha) < power else (low, middle)
    return math.exp(high)


def pairwise_power(rows: DataFrame, category: str, score: str, power: float = 0.8, alpha: float = 0.05, ratio: float = 1.0) -> DataFrame:
    """level1, level2, effect, samples: what each two levels need; the effect is |m1 - m2| over the root of both variances' sum. Solved on one row a pair."""
    pairs = level_pairs(moments(rows, category, score), category)
    effect = F.abs(F.col("mean1") - F.col("mean2")) / F.sqrt(F.pow("std1", 2) + F.pow("std2", 2))

    @F.pandas_udf("double")
    def samples(effect: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(e) or e == 0 else needed_samples(e, power, alpha, ratio) for e in effect], dtype=float)

    return pairs.select("level1", "level2", effect.alias("effect")).withColumn("samples", samples("effect"))
