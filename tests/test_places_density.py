"""Densities of points of which many share a place."""

from pyspark.sql import functions as F

from fieldtrace.operators import mesh, spatial


def test_density_of_copies_equals_that_of_all_pairs(spark):
    spots = [(tp, (k * k * 7) % 11 / 2, (k * 5) % 9 / 2, k % 4) for tp in (0, 1) for k in range(14)]
    points = [(tp, 10 * i + c, x, y) for i, (tp, x, y, n) in enumerate(spots) for c in range(n)] + [(2, 900 + c, 1.0, 1.0) for c in range(5)] + [(3, 990, 0.0, 0.0)]
    df = spark.createDataFrame(points, "tp int, pt long, x double, y double")
    near = spatial.grid_join(df, df, 2.5).filter("pt1 <> pt2").select("tp", F.col("pt1").alias("pt"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    rows = lambda out: {(r.tp, r.pt): round(r.area, 9) for r in out.collect()}
    want, got = rows(mesh.local_density(near)), rows(mesh.radius_density(df, 2.5))
    assert got == want and {got[2, 900 + c] for c in range(5)} == {0.0} and (3, 990) not in got
