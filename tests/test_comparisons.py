import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import comparisons, groups


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = [(g, a, None if b == "z" else b, float(rng.normal(shift, 1))) for g, shift in (("p", 0.0), ("q", 2.0)) for a in "xy" for b in "uz" for _ in range(12 if a == "x" else 9)]
    data = [(g, a, b, v + 3 * (g == "q" and a == "y")) for g, a, b, v in data] + [("p", "w", "u", 1.0), ("p", "x", "u", None)]
    return spark.createDataFrame(data, "g string, a string, b string, v double"), data


def test_groups_levels_and_correction(rows):
    df, data = rows
    got = {(r.group, r.level1, r.level2): (r.p, r.adjusted) for r in comparisons.compared(df, ["a", "b"], "v", group=["g"], keep_all=True).collect()}
    values = {}
    for g, a, b, v in data:
        if v is not None:
            values.setdefault((g, f"{a}/{b}"), []).append(v)
    want = {}
    for (g, one), x in values.items():
        for (h, two), y in values.items():
            if g == h and one < two and min(len(x), len(y)) > 1:
                df_ = len(x) + len(y) - 2
                pooled = ((len(x) - 1) * np.var(x, ddof=1) + (len(y) - 1) * np.var(y, ddof=1)) / df_
                want[g, one, two] = groups.student_p((np.mean(x) - np.mean(y)) / math.sqrt(pooled * (1 / len(x) + 1 / len(y))), df_)
    assert set(got) == set(want) and len(want) == 12  # the level of one value has no pair
    worst, order = 0.0, sorted(want, key=lambda k: (want[k], k))
    for i, k in enumerate(order):
        worst = max(worst, min(1.0, (len(order) - i) * want[k]))
        assert got[k] == (pytest.approx(want[k], abs=1e-12), pytest.approx(worst, abs=1e-12))
    few = comparisons.compared(df, ["a", "b"], "v", group=["g"])
    assert few.count() == sum(a <= 0.05 for _, a in got.values()) > 0
    assert {(r.level1, r.level2) for r in comparisons.compared(df, ["a"], "v", control=["w"], keep_all=True).collect()} == set()
    assert {(r.level1, r.level2) for r in comparisons.compared(df, ["a"], "v", control=["y"], keep_all=True).collect()} == {("x", "y")}


def test_other_tests(rows):
    df, _ = rows
    for test in ("u-test", "ks-test", "welch-t-test"):
        got = {(r.group, r.level1, r.level2): r.p for r in comparisons.compared(df.filter("a <> 'w'"), ["a"], "v", test, group=["g"], keep_all=True).collect()}
        assert set(got) == {("p", "x", "y"), ("q", "x", "y")} and got["q", "x", "y"] < 1e-3 < got["p", "x", "y"]
    one = comparisons.compared(df, ["a"], "v", lambda n1, m1, v1, n2, m2, v2: F.exp(-F.abs(m1 - m2)), keep_all=True).first()
    assert 0 < one.p < 1 and one.p == one.adjusted
    with pytest.raises(KeyError):
        comparisons.compared(df, ["a"], "v", "z-test")


def test_report(rows):
    df, _ = rows
    got = {r.level: r for r in comparisons.comparison_report(df, {"g": ["q"], "a": ["x", "y"]}, "a", "v").collect()}
    assert set(got) == {"x", "y"} and got["x"].differs == got["y"].differs == 1 and got["x"].n == 24
    assert comparisons.comparison_report(df, {"g": ["none"]}, "a", "v").count() == 0
