"""Searches in tiles: all partners, the nearest of them, and no pairs that Spark joins, sorts or spills."""

import math

import numpy as np
import pytest

from fieldtrace.operators import spatial, tiles


@pytest.mark.parametrize(("spread", "shift"), [(30.0, 0.0), (3.0, -1e6), (400.0, 5e8)])
def test_pairs_and_closest_equal_all_pairs(monkeypatch, spread, shift):
    monkeypatch.setattr(tiles, "CHUNK", 700)
    draw = np.random.default_rng(4)
    q, p = (np.round(draw.exponential(spread, (160, 2)) * 2) / 2 + shift for _ in "qp")
    whole = np.sqrt((q[:, None, 0] - p[None, :, 0]) ** 2 + (q[:, None, 1] - p[None, :, 1]) ** 2)
    found = [(i, j) for a, b, d in tiles.pairs(*q.T, *p.T, 4.0) for i, j, e in zip(a.tolist(), b.tolist(), d.tolist(), strict=True) if e <= 4.0]
    assert sorted(found) == list(zip(*(v.tolist() for v in np.nonzero(whole <= 4.0)), strict=True)) and len(set(found)) == len(found)
    for strict in (False, True):
        near = whole < 4.0 if strict else whole <= 4.0
        best, dist = tiles.closest(*q.T, *p.T, 4.0, strict)
        want = np.where(near.any(1), np.where(near, whole, np.inf).argmin(1), -1)
        assert best.tolist() == want.tolist() and (dist[want >= 0] == whole.min(1)[want >= 0]).all()
    but = np.where(near.any(1), want, -5)
    other = np.where(np.arange(160)[None, :] == but[:, None], np.inf, np.where(near, whole, np.inf))
    assert tiles.closest(*q.T, *p.T, 4.0, True, but)[0].tolist() == np.where(np.isfinite(other).any(1), other.argmin(1), -1).tolist()


def test_nearest_of_dense_frames_makes_no_pairs(spark):
    """Each place has some 2,500 others within the radius."""
    points = spark.range(10000).selectExpr("CAST(id % 2 AS INT) AS tp", "id AS pt", "CAST((id * 7919) % 5003 AS DOUBLE) / 1000 AS x", "CAST((id * 104729) % 4999 AS DOUBLE) / 1000 AS y")
    rows = points.collect()
    early, late = ([r for r in rows if r.tp == tp] for tp in (0, 1))
    links = spatial.nearest_links(points, spatial.earlier(points), 4.0)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    xy = np.array([(r.x, r.y) for r in early])
    claims = {}
    for r in late:
        d = np.sqrt((xy[:, 0] - r.x) ** 2 + (xy[:, 1] - r.y) ** 2)
        pt = min(early[i].pt for i in np.flatnonzero(d == d.min()))
        claims[pt] = min(claims.get(pt, (9.0, 0)), (float(d.min()), r.pt))
    assert {r.pt1: (r.dist, r.pt2) for r in links.collect()} == claims


def test_points_alone_in_either_frame(spark):
    data = [(0, 1, 0.0, 0.0), (0, 2, 9.0, 9.0), (1, 3, 1.0, 0.0), (1, 4, 9.0, 9.0), (1, 5, 9.0, 9.0), (2, 6, 1.0, 3.0), (5, 7, 0.0, 0.0), (5, 8, None, 0.0), (2, 9, None, 1.0)]
    points = spark.createDataFrame(data, "tp int, pt long, x double, y double")
    assert sorted(r.pt for r in spatial.without_isolated(points, 3.5).collect()) == [1, 2, 3, 6, 7, 8]
    near = lambda a, tp: any(b[0] == tp and None not in (a[2], b[2]) and math.dist(a[2:], b[2:]) < 3.5 for b in data) or all(b[0] != tp for b in data)
    assert [a[1] for a in data if near(a, a[0] + 1) and near(a, a[0] - 1)] == [1, 2, 3, 6, 7, 8]


@pytest.mark.parametrize("step", [1.0, 0.37])
def test_latest_ends_by_frames_and_by_moments(spark, step):
    """Whole steps are searched lag by lag, moments of their own all at once; ranks may be any column, arrays too."""
    draw = np.random.default_rng(8)
    moment = lambda: float(draw.integers(0, 4)) if step == 1.0 else float(draw.integers(0, 40)) * step + float(draw.random())
    rows = [(k, (k * 37) % 101, moment(), float(draw.integers(0, 9)), float(draw.integers(0, 9)), moment(), float(draw.integers(0, 9)), 0.5) for k in range(101)]
    tracks = spark.createDataFrame(rows, "track long, rank long, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double")
    want = {}
    for b in rows:
        found = [(b[2] - a[5], math.dist(a[6:], b[3:5]), a[1], a[0]) for a in rows if a[0] != b[0] and 0 < b[2] - a[5] <= 2.5 and math.dist(a[6:], b[3:5]) <= 3]
        if found:
            want[b[0]] = min(found)[3]
    assert {r.track: r.before for r in spatial.gap_candidates(tracks, 2.5, 3.0, "rank").collect()} == want
    listed = tracks.selectExpr("track", "array(0L, rank) AS rank", "t0", "x0", "y0", "t1", "x1", "y1")
    got = spatial.gap_candidates(listed, 2.5, 3.0, "rank")
    assert {r.track: r.before for r in got.collect()} == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_sums_run_in_order():
    """Added in pairs the ones would not be lost beside 2^53."""
    v = np.array([2.0**53, *[1.0] * 40, 5.0, 7.0])
    assert tiles.added(v, np.array([41, 2])).tolist() == [2.0**53, 12.0]
