"""Linear models and tail probabilities against whole-table least squares and known values."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry_points
from fieldtrace.operators import inference


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(f"c{a}", int(b), float(2 * a + 3 * b + a * b + rng.normal())) for a, b in zip(rng.integers(0, 3, 200), rng.integers(0, 4, 200), strict=True)]
    return data, spark.createDataFrame([*data, (None, 1, 2.0), ("c0", 1, None)], "a string, b int, v double")


def residual(blocks, y):
    x = np.hstack(blocks)
    return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()


def test_variance_table(rows):
    data, df = rows
    a, b = (np.array([[r[i] == level for level in sorted({r[i] for r in data})] for r in data], float) for i in (0, 1))
    y, one = np.array([r[2] for r in data]), np.ones((len(data), 1))
    ab = np.einsum("ij,ik->ijk", a, b).reshape(len(data), -1)
    left = [residual(x, y) for x in ([one], [one, a], [one, a, b], [one, a, b, ab])]
    found = {r.term: r for r in inference.variance_table(df, ["a", "b"], "v", True).collect()}
    assert [found[t].df for t in ("a", "b", "a:b", "residual")] == [2, 3, 6, 188]
    assert [found[t].ss for t in ("a", "b", "a:b", "residual")] == pytest.approx([left[0] - left[1], left[1] - left[2], left[2] - left[3], left[3]])
    assert 0 <= found["b"].p < 1e-6


def test_batch_effect(rows):
    data, df = rows
    a, b = (np.array([[r[i] == level for level in sorted({r[i] for r in data})] for r in data], float) for i in (0, 1))
    y = np.array([r[2] for r in data])
    part = np.linalg.lstsq(np.hstack([a, b]), y, rcond=None)[0][a.shape[1] :]
    want = sorted(y - b @ (part - part.mean()))
    found = inference.without_batch_effect(df, "a", ["b"], "v").filter("a is not null and v is not null").collect()
    assert sorted(r.adjusted for r in found) == pytest.approx(want)


def test_tails(spark):
    assert inference.fisher_p(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4)
    frame = spark.createDataFrame([(0.3, 50, 50, 1.959964), (0.0, 5, 5, -0.5)], "gap double, n1 long, n2 long, z double")
    first, second = frame.select(inference.kolmogorov_p(frame.gap, frame.n1, frame.n2).alias("k"), inference.normal_p("z").alias("p")).collect()
    x = 0.3 * math.sqrt(25)
    assert first.k == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 50))) and first.p == pytest.approx(0.05, abs=1e-6)
    assert (second.k, second.p) == (1.0, 1.0)


def test_rank_tests_small(spark):
    data = [("x", 1.0), ("x", 2.0), ("x", 2.0), ("y", 2.0), ("y", 3.0), ("z", None)]
    (row,) = inference.rank_tests(spark.createDataFrame(data, "c string, v double"), "c", "v").collect()
    assert (row.level1, row.level2, row.n1, row.n2, row.u) == ("x", "y", 3, 2, 1.0) and row.gap == pytest.approx(0.5)
    assert inference.rank_tests(spark.createDataFrame(data[:3], "c string, v double"), "c", "v").count() == 0
    assert inference.rank_tests(spark.createDataFrame([], "c string, v double"), "c", "v").count() == 0


def test_bootstrap_interval(spark, sf_dir):
    rng = np.random.default_rng(8)
    data = [("a", float(v)) for v in rng.integers(1, 51, 3000)] + [("b", 1.0), ("b", 2.0), ("c", None)] + [(None, float(v)) for v in rng.normal(5, 2, 400)]
    df = spark.createDataFrame(data, "k string, v double")
    found = {r.k: r for r in inference.bootstrap_interval(df.repartition(7), ["k"], "v", "5", 1000).collect()}
    again = {r.k: r for r in inference.bootstrap_interval(df.coalesce(1), ["k"], "v", "5", 1000).collect()}
    assert set(found) == {"a", "b", None} and (found["b"].n, found["b"].mean, found["b"].lo, found["b"].hi) == (2, 1.5, None, None)
    for k in ("a", None):
        values = np.array([v for x, v in data if x == k])
        wide = 1.96 * values.std() / len(values) ** 0.5
        assert found[k].n == len(values) and found[k].mean == pytest.approx(values.mean())
        assert [found[k].lo, found[k].hi] == pytest.approx([values.mean() - wide, values.mean() + wide], abs=0.15 * wide)
        assert [again[k].lo, again[k].hi] == pytest.approx([found[k].lo, found[k].hi])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = inference.bootstrap_interval(lines, ["l_returnflag", "l_linestatus"], "l_quantity", "5", 1000)
    rows = lambda frame: {(r.l_returnflag, r.l_linestatus, r.n): [r.mean, r.lo, r.hi] for r in frame.collect()}
    got, want = rows(entry_points.queries()["bootstrap_interval"](spark, sf_dir)), rows(want)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


@pytest.mark.parametrize(("effect", "want"), [(0.2, 393.4057), (0.5, 63.7656), (0.8, 25.5246)])
def test_needed_samples(effect, want):
    assert inference.needed_samples(effect) == pytest.approx(want, abs=1e-3)


def test_pairwise_power(spark):
    data = [("a", 0.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("c", 0.0), ("c", 2.0)]
    got = {(r.level1, r.level2): (r.effect, r.samples) for r in inference.pairwise_power(spark.createDataFrame(data, "c string, v double"), "c", "v").collect()}
    assert got["a", "c"] == (0.0, None) and got["a", "b"][0] == pytest.approx(1 / math.sqrt(2)) and got["a", "b"][1] == pytest.approx(inference.needed_samples(1 / math.sqrt(2)))
