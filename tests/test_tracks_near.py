"""Tracks that are near each other at any time."""

import math

from fieldtrace.operators import lookups


def test_tracks_near_are_found_both_ways_and_joined_once(spark):
    points = [(k % 4, k % 7, float(k * k % 13), float(k * 3 % 5)) for k in range(60)] + [(9, None, 0.0, 0.0), (9, 1, 0.0, 0.0)]
    df = spark.createDataFrame(points, "tp int, track long, x double, y double")
    want = {(a[1], b[1]) for a in points for b in points if None not in (a[1], b[1]) and a[0] == b[0] and a[1] != b[1] and math.dist(a[2:], b[2:]) <= 1.5}
    out = lookups.tracks_near(df, 1.5)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in text.splitlines()) == 1
