"""Tests between all levels of one or several columns, within groups, with one correction over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups, inference

#: Between the parts of a name that the user sees, and between group and level inside.
SHOWN, INSIDE = "/", "\x1f"

TESTS = ("t-test", "welch-t-test", "u-test", "ks-test")


def _name(columns: list[str]) -> Column:
    return F.concat_ws(SHOWN, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]) if columns else F.lit("")


def _of_moments(rows: DataFrame, test: str | Callable[..., Column]) -> DataFrame:
    """p-values from n, mean and variance of each level; levels of fewer than two values have no pair."""
    own = rows.groupBy("group", "level").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s")).filter("n > 1")
    a, b = (own.select("group", *[F.col(c).alias(f"{c}{i}") for c in ("level", "n", "m", "s")]) for i in (1, 2))
    pairs = a.join(b, "group").filter("level1 < level2")
    n1, n2, e1, e2 = F.col("n1"), F.col("n2"), F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    if callable(test):
        return pairs.select("group", "level1", "level2", test(n1, F.col("m1"), F.col("s1"), n2, F.col("m2"), F.col("s2")).alias("p"))
    if test == "welch-t-test":
        error, df = F.sqrt(e1 + e2), F.pow(e1 + e2, 2) / (F.pow(e1, 2) / (n1 - 1) + F.pow(e2, 2) / (n2 - 1))
    else:
        error, df = F.sqrt(((n1 - 1) * F.col("s1") + (n2 - 1) * F.col("s2")) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), n1 + n2 - 2.0
    found = pairs.select("group", "level1", "level2", ((F.col("m1") - F.col("m2")) / error).alias("t"), df.alias("df"))
    return found.withColumn("p", groups.student_p_column("t", "df")).drop("t", "df")


def _of_ranks(rows: DataFrame, test: str, control: list[str] | None) -> DataFrame:
    """p-values of the rank tests; the levels of all groups share one pass over the values in order, which only makes the pairs of a group that are asked for."""

    def wanted(one: str, two: str) -> bool:
        (group, level1), (other, level2) = one.split(INSIDE), two.split(INSIDE)
        return group == other and (control is None or level1 in control or level2 in control)

    found = inference.rank_tests(rows.select(F.concat("group", F.lit(INSIDE), "level").alias("name"), "v"), "name", "v", wanted)
    part = lambda i, k: F.split(F.col(f"level{i}"), INSIDE)[k]
    p = inference.normal_p("z") if test == "u-test" else inference.kolmogorov_p(F.col("gap"), F.col("n1"), F.col("n2"))
    return found.withColumn("p", p).select(part(1, 0).alias("group"), part(1, 1).alias("level1"), part(2, 1).alias("level2"), "p")


def compared(rows: DataFrame, category: list[str], score: str, test: str | Callable[..., Column] = "t-test", group: list[str] | None = None, control: list[str] | None = None, correction: str = "holm", alpha: float = 0.05, keep_all: bool = False) -> DataFrame:
    """(group, level1, level2, p, adjusted): each two levels, once and in order of name, within each group.

    Levels and groups of several columns are named by their values with a slash between; a null is None. ``test`` is one of ``TESTS`` or makes
    a p-value column of n1, mean1, var1, n2, mean2, var2. With ``control`` only pairs with one of these levels. The correction covers all
    comparisons of all groups; of its values those up to ``alpha`` stay, or all.
    """
    if not callable(test) and test not in TESTS:
        raise KeyError(f"no test {test}")
    named = rows.filter(F.col(score).isNotNull()).select(_name(group or []).alias("group"), _name(category).alias("level"), F.col(score).cast("double").alias("v"))
    found = _of_ranks(named, test, control) if test in ("u-test", "ks-test") else _of_moments(named, test)
    if control is not None:
        found = found.filter(F.col("level1").isin(control) | F.col("level2").isin(control))
    out = inference.corrected(found, "p", ["group", "level1", "level2"], [correction]).withColumnRenamed(correction, "adjusted")
    return out if keep_all else out.filter(F.col("adjusted") <= alpha)


def comparison_report(rows: DataFrame, subset: dict[str, list], category: str, score: str, alpha: float = 0.05) -> DataFrame:
    """(level, mean, std, n, differs): the levels of the rows that ``subset`` keeps (values by column), and from how many others each differs."""
    for column, values in subset.items():
        rows = rows.filter(F.col(column).isin(values))
    own = rows.filter(F.col(score).isNotNull()).groupBy(_name([category]).alias("level")).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n"))
    pairs = compared(rows, [category], score, alpha=alpha)
    marks = pairs.select(F.explode(F.array("level1", "level2")).alias("level")).groupBy("level").agg(F.count("*").alias("differs"))
    return own.join(marks, "level", "left").na.fill({"differs": 0})
