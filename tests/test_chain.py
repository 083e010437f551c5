"""Windows of the persistence chain: nothing is joined, and no row reads all rows behind it."""

from pyspark.sql import functions as F

from fieldtrace.operators import persistence


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n=12):
    rows = [(t, k, k * 1.5, float((k * k) % 7), None if k < t else float(k % 4)) for t in range(3) for k in range(n)]
    return spark.createDataFrame(rows, "track long, tp int, t double, x double, y double")


def test_the_chain_is_windows_of_one_exchange(spark):
    text = plan(persistence.waveform(persistence.timeline(points(spark))))
    assert "Join" not in text and text.count("Exchange") == 1
    assert "currentrow$(), unboundedfollowing" not in text


def test_first_fits_are_held_where_a_track_begins_with_nulls(spark):
    got = {(r.track, r.tp): r.slope for r in persistence.rolling_fit(points(spark), 3, "tp", "y").collect()}
    for t in range(3):
        rows = [(k, None if k < t else float(k % 4)) for k in range(12)]
        full = {k: (rows[k + 1][1] - rows[k - 1][1]) / 2 for k in range(1, 11) if None not in (rows[k - 1][1], rows[k][1], rows[k + 1][1])}
        last = None
        for k in range(12):
            last = full.get(k, last)
            want = last if last is not None else full[min(full)]
            assert abs(got[t, k] - want) < 1e-9


def test_islands_of_many_runs_are_met_by_time(spark):
    runs = spark.createDataFrame([(0, 1, 3), (0, 5, 8), (1, 2, 4)], "track long, start int, stop int")
    df = persistence.islands(points(spark).select("track", "tp", "t", "x", F.coalesce("y", F.lit(0.0)).alias("y")), runs)
    assert {(r.track, r.start): r.duration for r in df.collect()} == {(0, 1): 4.5, (0, 5): 6.0, (1, 2): 4.5}
    assert "tp" in [line for line in plan(df).splitlines() if "Join" in line][0]
