"""Pairs within a radius are searched over places and spread over their points."""

import pytest

from fieldtrace.operators import spatial


@pytest.mark.parametrize("crowd", [512, 2])
def test_pairs_and_edges(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    data = [(tp, 1000 * tp + 10 * i + c, (i * 7 % 11) / 2 - 2, (i * 5 % 7) / 2 - 1) for tp in (0, 1) for i in range(20) for c in range(1 + i % 5)] + [(0, 9999, None, 1.0)]
    points = spark.createDataFrame(data, "tp int, pt long, x double, y double").repartition(3)
    whole = [p for p in data if p[2] is not None]
    near = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
    edges = sorted(tuple(r) for r in spatial.radius_edges(points, 1.5).collect())
    assert edges == sorted((a[0], a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and near(a, b) <= 1.5**2)
    pairs = sorted((r.tp, r.pt1, r.pt2) for r in spatial.next_frames(points, 1.5, strict=True).collect())
    assert pairs == sorted((a[0], a[1], b[1]) for a in whole for b in whole if b[0] == a[0] + 1 and near(a, b) < 1.5**2)


def test_places_are_searched_once(spark):
    points = spark.range(2000).selectExpr("CAST(id % 2 AS INT) AS tp", "id AS pt", "1.0D AS x", "CAST(id % 4 AS DOUBLE) AS y")
    plan = spatial.radius_edges(points, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(pt1") < plan.index("SortMergeJoin")
    assert spatial.radius_edges(points, 0.5).count() == 4 * 500 * 499 // 2
