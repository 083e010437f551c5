"""Two hops and soft assignment where many points share a place: the copies are met once."""

import numpy as np

from fieldtrace.operators import mesh, softassign, spatial


def test_two_hops_equal_those_of_the_graph(spark):
    draw = np.random.default_rng(3)
    rows = [(k % 2, k, float(x), float(y)) for k, (x, y) in enumerate(draw.integers(-12, 30, (220, 2)) / 2)]
    rows += [(tp, pt + 1000, x, y) for tp, pt, x, y in rows[:60]] + [(0, 5000, None, 1.0)]
    points = spark.createDataFrame(rows, "tp int, pt long, x double, y double")
    edges = spatial.grid_join(points, points, 2.0).filter("pt1 < pt2").selectExpr("tp", "pt1 AS a", "pt2 AS b")
    got, want = mesh.two_hops(points, 2.0), mesh.neighbours(points, edges, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("tp", "pt", "near").collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_copies_are_balanced_by_place(monkeypatch):
    """Six points a place: what is balanced are the places, and each point's weight is that of the points taken singly."""
    draw = np.random.default_rng(5)
    a, b = (np.repeat(draw.random((9, 2)) * 3, 6, axis=0) for _ in "ab")
    seen, real = [], softassign.balanced
    monkeypatch.setattr(softassign, "balanced", lambda i, j, w, rows, columns, *rest: seen.append((len(rows), len(columns))) or real(i, j, w, rows, columns, *rest))
    i, j, w, shift = softassign.assigned(a, b, 1.5)
    assert set(seen) == {(9, 9)}
    ones = np.ones(len(a))
    i1, j1, w1, shift1 = softassign._assigned_places(a, b, ones, ones, np.arange(len(b)), 1.5, softassign.Annealing())
    assert len(i) and i.tolist() == i1.tolist() and np.allclose(w, w1) and np.allclose(shift, shift1)
    assert all((b[p] == b[q]).all() for p, q in zip(j, j1, strict=True))
