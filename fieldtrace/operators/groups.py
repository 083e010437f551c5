"""Summaries, bins, tests and curves over observations."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.operators import ranks

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def category_summary(rows: DataFrame, categories: list[str], score: str) -> DataFrame:
    """Percentiles, mean, population deviation and size; one value has only mean and median."""
    #: Values are counted before they meet, and one table of a category's values serves all percentiles.
    counted = rows.filter(F.col(score).isNotNull()).groupBy(*categories, score).agg(F.count("*").alias("_n"))
    ends = counted.groupBy(*categories).agg(F.percentile(score, list(PERCENTILES), F.col("_n")).alias("_p")).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(categories)], "_p")
    whole = rows.groupBy(*categories).agg(F.avg(score).alias("mean"), F.when(F.count(score) > 1, F.stddev_pop(score)).alias("std"), F.count(score).alias("n"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(categories)])
    each = [(F.col("_p")[i] if p == 0.5 else F.when(F.col("n") > 1, F.col("_p")[i])).alias(f"p{round(p * 100):02d}") for i, p in enumerate(PERCENTILES)]
    return whole.join(ends, same, "left").select(*categories, *each, "mean", "std", "n")


def bin_edges(bins: int, equal_area: bool, low: float = 0.0, high: float = 1.0) -> list[float]:
    return [math.sqrt(low**2 + (high**2 - low**2) * i / bins) if equal_area else low + (high - low) * i / bins for i in range(bins + 1)]


def radial_bins(rows: DataFrame, radius: str, bins: int, equal_area: bool, overflow: float = 1.1, decimals: int = 1) -> DataFrame:
    """Rows with column ``bin``; bins are [low, high), the last reaches to ``overflow`` though its label says 1."""
    edges = bin_edges(bins, equal_area)
    label, r = F.lit(None).cast("string"), F.col(radius)
    for a, b in zip(edges, edges[1:], strict=False):
        stop = overflow if b == edges[-1] else b
        label = F.when((r >= a) & (r < stop), F.lit(f"{a:.{decimals}f}-{b:.{decimals}f}")).otherwise(label)
    return rows.filter(r.isNotNull() & ~F.isnan(r)).withColumn("bin", label).filter("bin is not null")


def moments(rows: DataFrame, category: str, score: str) -> DataFrame:
    return rows.filter(F.col(score).isNotNull()).groupBy(category).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.var_samp(score).alias("var"), F.stddev_pop(score).alias("std")).filter("n > 1")


def level_pairs(levels: DataFrame, category: str, control: list[str] | None = None) -> DataFrame:
    """Each two levels once, in order of name; with ``control`` only pairs with one of these. Levels are few: they are aggregates."""
    a, b = (levels.select(*[F.col(c).alias(f"{'level' if c == category else c}{i}") for c in levels.columns]) for i in (1, 2))
    pairs = a.join(b, F.col("level1") < F.col("level2"))
    return pairs if control is None else pairs.filter(F.col("level1").isin(control) | F.col("level2").isin(control))


def effect_size() -> Column:
    """|m1 - m2| over the pooled population deviation, which divides by n1 + n2."""
    return F.abs(F.col("mean1") - F.col("mean2")) / F.sqrt(((F.col("n1") - 1) * F.pow("std1", 2) + (F.col("n2") - 1) * F.pow("std2", 2)) / (F.col("n1") + F.col("n2")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not df > 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p_column(t: str, df: str) -> Column:
    """p-values of a table with one row per pair of levels."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(np.array([student_p(a, b) for a, b in zip(t, df, strict=True)], float))

    return p(t, df)


def pairwise_t(rows: DataFrame, category: str, score: str, welch: bool = True, control: list[str] | None = None) -> DataFrame:
    """level1, level2, t, df, effect of each two levels."""
    pairs = level_pairs(moments(rows, category, score), category, control)
    s1, s2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2)
    error = F.sqrt(s1 + s2) if welch else F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    df = F.pow(s1 + s2, 2) / (F.pow(s1, 2) / (F.col("n1") - 1) + F.pow(s2, 2) / (F.col("n2") - 1)) if welch else F.col("n1") + F.col("n2") - 2.0
    return pairs.select("level1", "level2", ((F.col("mean1") - F.col("mean2")) / error).alias("t"), df.alias("df"), effect_size().alias("effect"))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Holm's step-down correction as column ``adjusted``; the table has one row per pair of levels."""
    order = Window.orderBy(p, "level1", "level2")
    rows = tests.withColumn("k", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    raw = (F.col("m") - F.col("k") + 1) * F.col(p)
    return rows.withColumn("adjusted", F.least(F.lit(1.0), F.max(raw).over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("k", "m")


def significance(rows: DataFrame, category: str, score: str, alpha: float = 0.05, welch: bool = False, control: list[str] | None = None, keep_all: bool = False) -> DataFrame:
    tests = holm(pairwise_t(rows, category, score, welch, control).withColumn("p", student_p_column("t", "df")))
    return tests if keep_all else tests.filter(F.col("adjusted") <= alpha)


def tested(rows: DataFrame, category: str, score: str, test: Callable[..., Column], control: list[str] | None = None) -> DataFrame:
    """level1, level2, p, effect, adjusted: ``test`` makes a p-value column of n1, mean1, var1, n2, mean2, var2."""
    pairs = level_pairs(moments(rows, category, score), category, control)
    p = test(*[F.col(c) for c in ("n1", "mean1", "var1", "n2", "mean2", "var2")])
    return holm(pairs.select("level1", "level2", p.alias("p"), effect_size().alias("effect")))


def running_totals(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Sums of ``columns`` from the greatest ``by`` down to each row; values of ``by`` are distinct.

    Rows are dealt to stretches of about equal numbers of rows and summed within them; only the stretches' totals meet in one task.
    """
    rows = rows.withColumn("bucket", ranks.stretch(by, ranks.bounds(rows, by)))
    before = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("bucket").agg(*[F.sum(c).alias(f"{c}_all") for c in columns]).select("bucket", *[F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_before") for c in columns])
    own = Window.partitionBy("bucket").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(totals), "bucket").withColumns({c: F.sum(c).over(own) + F.col(f"{c}_before") for c in columns})
    return joined.drop("bucket", *[f"{c}_before" for c in columns])


def score_curve(rows: DataFrame) -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision) from rows (truth, score), by score downwards; equal scores are one step."""
    steps = rows.groupBy("score").agg(F.sum("truth").alias("tp"), F.sum(1 - F.col("truth")).alias("fp"))
    total = rows.agg(F.sum("truth").alias("np"), F.sum(1 - F.col("truth")).alias("nq"))
    out = running_totals(steps, "score", ["tp", "fp"]).join(F.broadcast(total), F.lit(True))
    return out.select("score", "tp", "fp", (F.col("tp") / F.col("np")).alias("tpr"), (F.col("fp") / F.col("nq")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def roc_summary(curve: DataFrame) -> DataFrame:
    """auc by trapezoids from (0, 0), and the score of the point nearest to (0, 1)."""
    x0, y0 = (F.coalesce(f"before_{c}", F.lit(0.0)) for c in ("fpr", "tpr"))
    area = (F.col("fpr") - x0) * (F.col("tpr") + y0) / 2
    return ranks.previous(curve, "score", ["fpr", "tpr"]).withColumn("area", area).agg(F.sum("area").alias("auc"), F.min_by("score", F.struct(F.round(F.pow("fpr", 2) + F.pow(1 - F.col("tpr"), 2), 9), -F.col("score"))).alias("knee"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal bins between least and greatest value, the last edge included, as (bin, centre, n, share)."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    placed = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    number = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = placed.groupBy(F.coalesce(number, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def extreme_bounds(rows: DataFrame, score: str, most: float, how: str = "mean", by: list[str] | None = None) -> DataFrame:
    """lo and hi, ``most`` extents from the centre; below three values there are none."""
    centre, extent = (F.avg(score), F.stddev_pop(score)) if how == "mean" else (F.median(score), F.percentile(score, 0.75) - F.percentile(score, 0.25))
    enough = F.count(score) >= 3
    return rows.groupBy(*(by or [])).agg(F.when(enough, centre - extent * most).alias("lo"), F.when(enough, centre + extent * most).alias("hi"))


def without_extremes(rows: DataFrame, score: str, most: float, how: str = "mean") -> DataFrame:
    return rows.crossJoin(F.broadcast(extreme_bounds(rows, score, most, how))).filter(F.coalesce((F.col(score) >= F.col("lo")) & (F.col(score) <= F.col("hi")), F.col("lo").isNull())).drop("lo", "hi")


def outlier_bands(rows: DataFrame, category: str, score: str, least: float, most: float) -> DataFrame:
    """Per category: rows ``least`` to ``most`` deviations above and below the mean, and their share."""
    own = rows.groupBy(category).agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("s"))
    z = (F.col(score) - F.col("m")) / F.col("s")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = rows.join(own, category).groupBy(category).agg(count((z > least) & (z <= most)).alias("above"), count((z < -least) & (z >= -most)).alias("below"), F.count("*").alias("n"))
    return out.withColumn("share", (F.col("above") + F.col("below")) / F.col("n"))


def anova(rows: DataFrame, factor: str, score: str) -> DataFrame:
    """One-way analysis of variance: df, sums of squares, F."""
    cells = rows.groupBy(factor).agg(F.count(score).alias("n"), F.sum(score).alias("s"), F.sum(F.pow(score, 2)).alias("q"))
    t = cells.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    t = t.select((F.col("k") - 1).alias("df"), (F.col("n") - F.col("k")).alias("df_residual"), (F.col("b") - F.col("s") * F.col("s") / F.col("n")).alias("ss"), (F.col("q") - F.col("b")).alias("ss_residual"))
    return t.withColumn("f", F.col("ss") / F.col("df") / (F.col("ss_residual") / F.col("df_residual")))


def contrast_groups(rows: DataFrame, experiment: str, contrast: str) -> DataFrame:
    """Rows of experiments with more than one level of ``contrast``."""
    mixed = rows.groupBy(experiment).agg(F.min(contrast).alias("a"), F.max(contrast).alias("b")).filter("a <> b").select(experiment)
    return rows.join(mixed, experiment, "left_semi")


def compartments(rows: DataFrame, entity: str, value: str, bins: int, top: int) -> DataFrame:
    """``bins`` evenly placed groups of ``top`` entities by value: (entity, bin); groups may overlap. Too few entities give none."""
    ranked = ranks.ranked(rows.select(entity, value), value, entity, "r").withColumnRenamed("_n", "n")
    placed = ranked.filter(F.col("n") >= top).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    start = F.floor((F.col("n") - top) * F.col("bin") / max(1, bins - 1))
    return placed.filter((F.col("r") >= start) & (F.col("r") < start + top)).select(entity, value, "bin")


def hashed_split(rows: DataFrame, key: str, seed: str, test: float, validation: float) -> DataFrame:
    """Column ``split`` of exactly round(n * share) test and validation rows, the first in an order of hashes."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")))).withColumn("_s", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    ranked = ranks.placed(hashed, ["_s"], ["_h", key], "_r").withColumn("_r", F.col("_r") + 1).drop("_h", "_s")
    a, b = F.round(F.col("_n") * test), F.round(F.col("_n") * validation)
    return ranked.withColumn("split", F.when(F.col("_r") <= a, "test").when(F.col("_r") <= a + b, "validation").otherwise("train")).drop("_r", "_n")


def replicate_means(rows: DataFrame, category: str, sample: str, score: str, least: int = 3) -> DataFrame:
    """Mean, population deviation and size of each sample of a category; samples with fewer than ``least`` rows go."""
    return rows.groupBy(category, sample).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n")).filter(F.col("n") >= least)


def density(rows: DataFrame, value: str, bandwidth: float, points: int = 100, fine: int = 1024) -> DataFrame:
    """Gaussian kernel density on ``points`` even places from least to greatest value: (place, at, density).

    Values are first counted in ``fine`` bins, so that work beyond one pass over the rows is bounded by bins times places.
    """
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    width = (F.col("hi") - F.col("lo")) / fine
    bins = rows.filter(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(fine - 1))).otherwise(0).alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    at = F.col("lo") + F.col("place") * (F.col("hi") - F.col("lo")) / (points - 1)
    spread = bins.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", at).withColumn("z", (F.col("at") - F.col("lo") - (F.col("bin") + 0.5) * width) / bandwidth)
    kernel = F.exp(-F.pow("z", 2) / 2) / (bandwidth * math.sqrt(2 * math.pi))
    return spread.groupBy("place", "at").agg(F.sum(F.col("n") * kernel / F.col("total")).alias("density"))


def natural_order(rows: DataFrame, category: str) -> DataFrame:
    """Distinct categories with their place: whole numbers first by value, then the others by text."""
    number = F.expr(f"try_cast({category} as bigint)")
    return rows.select(category).distinct().withColumn("place", F.row_number().over(Window.orderBy(number.asc_nulls_last(), category)))


def percent_subset(rows: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """round(share * n) of the keys, the first by hash with ``seed``. Split as in ``hashed_split``."""
    return hashed_split(rows, key, seed, share, 0.0).filter("split = 'test'").select(key)
