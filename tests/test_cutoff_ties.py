"""Slopes that are just at a cutoff and values that are just at a rounded half fall as in the SQL."""

import duckdb
import pytest

from fieldtrace.operators import persistence
from fieldtrace.plans import catalogue

#: Seven values whose slope over their place is 8 or -8, and the place of the middle one; plain running means miss the SQL's side.
WINDOWS = [
    ([1.72, 15.53, 39.88, 34.99, 69.08, 41.71, 49.2], 16),
    ([13.41, 183.55, 9.49, 20.3, 15.6, 52.79, 23.88], 68),
    ([90.58, 27.94, 63.05, 78.63, 44.1, 9.01, 34.85], 10),
    ([17.23, 36.3, 33.71, 2.34, 91.58, 101.2, 29.34], 30),
]


def test_slopes_at_the_cutoff(spark):
    rows = [(i, at - 3 + k, v) for i, (values, at) in enumerate(WINDOWS) for k, v in enumerate(values)]
    points = spark.createDataFrame(rows, "track long, tp int, x double")
    con = duckdb.connect()
    con.execute("CREATE TABLE p (track BIGINT, tp BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT track, regr_slope(x, tp ORDER BY tp) FROM p GROUP BY track").fetchall())
    got = {r["track"]: r["slope"] for r in persistence.rolling_fit(points, 7, "tp", "x").collect()}
    assert got == want and {abs(v) < 8 for v in want.values()} == {True, False}


@pytest.mark.parametrize("value", [7583.117249999999, -7583.117249999999, 0.00005, 1e306, float("inf"), 2.5, 13835.09285, -0.00004])
def test_halves_round_as_in_the_sql(spark, value):
    (got,) = spark.createDataFrame([(value,)], "v double").select(catalogue.rounded("v", 4)).first()
    (want,) = duckdb.execute("SELECT round(?::DOUBLE, 4)", [value]).fetchone()
    assert got == want
