"""Sums over a run of points: in order of the points, however the rows are dealt out."""

from fieldtrace.operators import persistence


def test_sums_run_in_order_of_points(spark):
    """After a step of 2^53 each step of one is lost to rounding; added to each other first they are not."""
    rows = [(1, 0, 0.0, -(2.0**53), 0.0)] + [(1, k, float(k), float(k % 2), 0.0) for k in range(1, 200)]
    rows[1] = (1, 1, 1.0, 0.0, 0.0)
    runs = spark.createDataFrame([(1, 0, 199)], "track long, start int, stop int")
    points = spark.createDataFrame(rows, "track long, tp int, t double, x double, y double")
    dealt = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {name: spark.conf.get(name) for name in dealt}
    try:
        for name, value in dealt.items():
            spark.conf.set(name, value)
        (row,) = persistence.islands(points, runs).collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert row["distance"] == 2.0**53 and row["duration"] == 199.0
