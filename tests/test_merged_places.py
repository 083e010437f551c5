"""Balls of points of which many share a place, and frames merged without making points again."""

import math

from fieldtrace.operators import imputation, spatial


def points():
    return [(tp, 100 * k + c, float(k * k % 7), float(k * 5 % 4)) for tp in (0, 1, 2) for k in range(12) for c in range(k % 3 + 1)] + [(0, 9999, None, 1.0)]


def test_balls_of_copies_equal_a_walk_over_all_pairs(spark):
    rows = [p for p in points() if p[2] is not None]
    heads = {}
    for b in rows:
        heads.setdefault((b[0], min(a[1] for a in rows if a[0] == b[0] and math.dist(a[2:], b[2:]) <= 1)), []).append(b)
    want = {k: (round(sum(p[2] for p in v) / len(v), 9), round(sum(p[3] for p in v) / len(v), 9), len(v)) for k, v in heads.items()}
    df = spark.createDataFrame(points(), "tp int, pt long, x double, y double")
    assert {(r.tp, r.head): (round(r.x, 9), round(r.y, 9), r.n) for r in spatial.clustered(df, 1.0).collect()} == want


def test_made_points_are_made_once_for_merged_frames(spark):
    df = spark.createDataFrame(points(), "tp int, pt long, x double, y double")
    made = imputation.made_points(df, imputation.radius_edges(df, 2.0), spatial.nearest_links(df, spatial.earlier(df), 2.0), least_points=1)
    text = imputation.merged_frames(df, made)._jdf.queryExecution().optimizedPlan().toString()
    assert "dx" not in text
