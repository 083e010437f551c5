import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import reports, resampling


def by_hand(values, counts, key, boots, share):
    """Each resample written out as a list of values."""
    w = resampling.weights(np.array(key), np.array(counts), boots)
    return [np.quantile(np.repeat(values, w[:, b]), share) for b in range(1, boots + 1) if w[:, b].sum()]


def keys_of(spark, group, values, seed):
    df = spark.createDataFrame([(group, float(v)) for v in values], "k string, v double")
    digest = F.md5(F.concat_ws("/", F.lit(seed), "k", F.col("v").cast("string")))
    return [r[0] for r in df.select(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).collect()]


@pytest.mark.parametrize("few", [4096, 10])
def test_quantiles_equal_resampling_by_hand(spark, monkeypatch, few):
    """In one stretch and in many."""
    monkeypatch.setattr(resampling, "FEW_VALUES", few)
    rng = np.random.default_rng(3)
    data = {"a": rng.integers(0, 40, 900) / 4, "b": rng.normal(5, 2, 300), "c": np.array([1.0, 7.0]), "d": np.array([2.0] * 5000 + [3.0] * 4999)}
    df = spark.createDataFrame([(k, float(v)) for k, own in data.items() for v in own] + [("a", None), ("e", None)], "k string, v double")
    for share in (0.5, 0.9):
        got = {r.k: r for r in resampling.bootstrap(df.repartition(5), ["k"], "v", resampling.Quantile(share), "s", 200).collect()}
        assert set(got) == set(data) and got["c"].lo is None and got["c"].hi is None
        for k, own in data.items():
            assert got[k].n == len(own) and got[k].centre == pytest.approx(np.quantile(own, share))
            if len(own) > 2:
                values, counts = np.unique(own, return_counts=True)
                want = by_hand(values, counts, keys_of(spark, k, values, "s"), 200, share)
                assert [got[k].lo, got[k].hi] == pytest.approx(np.percentile(want, [2.5, 97.5]).tolist())


def test_sums_and_other_keys(spark):
    rng = np.random.default_rng(4)
    own = rng.normal(3, 2, 2000)
    df = spark.createDataFrame([(None, "x", float(v)) for v in own], "k int, `my col` string, v double")
    row = resampling.bootstrap(df, ["k", "my col"], "v", resampling.DEVIATION, boots=400).first()
    assert row.k is None and row["my col"] == "x" and row.centre == pytest.approx(own.std()) and row.lo < own.std() < row.hi
    skew = resampling.Sums(lambda v: [v, F.pow(v - 3, 3)], lambda w, s, c: c / w)
    row = resampling.bootstrap(df, [], "v", skew, boots=100).first()
    assert row.centre == pytest.approx(((own - 3) ** 3).mean())
    assert resampling.bootstrap(df.limit(0), ["k"], "v", resampling.MEDIAN).count() == 0


def test_weights_have_the_mean_of_copies():
    for n in (1, 3, 70, 9000):
        w = resampling.weights(np.arange(20, dtype=np.int64) << 40, np.full(20, n), 2000)[:, 1:]
        assert w.mean() == pytest.approx(n, rel=0.02) and w.var() == pytest.approx(n, rel=0.05)


def test_too_few_compartments(spark):
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "track long, bin long")
    rows = spark.createDataFrame([(t, x, float(t * x)) for t in (1, 2, 3) for x in range(4)], "track long, x long, v double")
    with pytest.raises(ValueError):
        reports.compartment_intervals(members, rows, "track", "x", "v", 2)
    assert reports.compartment_intervals(members, rows, "track", "x", "v", 1, boots=20).count() == 8
