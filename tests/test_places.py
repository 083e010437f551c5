"""Searches over points of which many share a place, and rows that are spread before a join."""

import math

from pyspark.sql import functions as F

from fieldtrace.operators import linking, rasters, spatial, tolerance


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def copies(n=6, seed=7):
    spots = [(tp, (seed * k * k) % 11 / 2, (seed * k) % 7 / 2) for tp in (0, 1, 2) for k in range(n)]
    return [(tp, 100 * c + i, float(x), float(y)) for i, (tp, x, y) in enumerate(spots) for c in (2, 0, 1)]


def test_links_of_copies_equal_a_walk_over_all_pairs(spark):
    points = copies()
    df = spark.createDataFrame(points, "tp int, pt long, x double, y double")
    pairs = [(math.dist(a[2:], b[2:]), a, b) for a in points for b in points if b[0] == a[0] + 1 and math.dist(a[2:], b[2:]) < 2]
    claims = {}
    for d, a, b in pairs:
        claims[a[0], b[1]] = min(claims.get((a[0], b[1]), (9, 0)), (d, a[1]))
    won, one = {}, {}
    for (tp, pt2), (d, pt1) in claims.items():
        won[tp, pt1] = min(won.get((tp, pt1), (9, 0)), (d, pt2))
    for d, a, b in pairs:
        one[a[0], a[1]] = min(one.get((a[0], a[1]), (9, 0)), (d, b[1]))
    row = lambda df: sorted((r.tp, r.pt1, r.pt2) for r in df.collect())
    assert row(spatial.nearest_links(df, spatial.earlier(df), 2.0)) == sorted((tp, pt1, pt2) for (tp, pt1), (_, pt2) in won.items())
    assert row(spatial.mutual_links(df, spatial.earlier(df), 2.0)) == sorted((tp, pt1, pt2) for (tp, pt1), (_, pt2) in one.items() if claims[tp, pt2][1] == pt1)


def test_gaps_of_copies_and_of_tracks_that_end_before_they_start(spark):
    tracks = [(3 * k + c, float(k % 4), k % 3 * 1.0, 0.0, k % 4 + (1.0 if k % 5 else -1.0), k % 3 * 1.0, 1.0) for k in range(12) for c in range(3)]
    df = spark.createDataFrame(tracks, "track long, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double")
    want = {}
    for b in tracks:
        found = [(b[1] - a[4], math.dist(a[5:], b[2:4]), a[0]) for a in tracks if a[0] != b[0] and 0 < b[1] - a[4] <= 2 and math.dist(a[5:], b[2:4]) <= 1.5]
        if found:
            want[b[0]] = min(found)
    assert {r.track: (r.lag, r.dist, r.before) for r in spatial.gap_candidates(df, 2.0, 1.5).collect()} == want


def test_spread_rows_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame(copies(), "tp int, pt long, x double, y double").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    px = points.select(F.col("tp").cast("string").alias("image"), (F.col("pt") % 4).cast("int").alias("row"), F.floor(F.col("pt") / 4).cast("int").alias("col"), F.col("x").alias("value"))
    assert "Broadcast" not in plan(spatial.grid_join(points, points, 1.0))
    assert "Broadcast" not in plan(tolerance.near_rows(points, ("x", "y"), ["tp"], "pt", 0.5))
    assert plan(rasters.adaptive_contrast(px, 2)).count("SortMergeJoin") >= 1


def test_groups_of_copies(spark):
    points = copies() + [(5, 1, 0.0, 0.0), (5, 2, 50.0, 0.0), (5, 3, 50.0, 0.0), (5, 4, None, 0.0)]
    df = spark.createDataFrame(points, "tp int, pt long, x double, y double")
    near = {a[:2]: [b[:2] for b in points if b[0] == a[0] and None not in (a[2], b[2]) and math.dist(a[2:], b[2:]) <= 1] for a in points}
    want = []
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if len(seen) > 1:
            want.append((*a, min(seen)[1]))
    assert sorted(tuple(r) for r in linking.radius_groups(df, 1.0).collect()) == sorted(want)
