"""Meshes: empty circles by brute force, and small fixtures with known values."""

import numpy as np
import pytest

from fieldtrace.operators import mesh


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_circles_are_empty(seed):
    rng = np.random.default_rng(seed)
    xy = rng.random((80, 2)) * 100
    found = mesh.triangulate(xy)
    circles = mesh._circle(xy, found)
    gaps = np.sqrt(((xy[None] - circles[:, None, :2]) ** 2).sum(2)) - np.sqrt(circles[:, 2])[:, None]
    assert gaps.min() > -1e-3
    sides, times = np.unique(np.sort(found[:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), 1), axis=0, return_counts=True)
    assert times.max() == 2 and len(xy) - len(sides) + len(found) == 1


def test_grid_and_lines():
    grid = np.array([[i, j] for i in range(6) for j in range(5)], float)
    assert len(mesh.triangulate(grid)) == 2 * 5 * 4
    assert len(mesh.triangulate(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 0
    assert len(mesh.triangulate(np.empty((0, 2)))) == 0


def test_frames(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 1.0, 1.0), (1, 3, 0.0, 1.0), (1, 4, 0.5, 0.5), (1, 5, 0.5, 0.5), (1, 6, None, 1.0), (1, 7, 90.0, 0.0), (2, 0, 1.0, 1.0)]
    t = mesh.delaunay(spark.createDataFrame(rows, "tp int, pt int, x double, y double"), 10.0)
    assert sorted((r.a, r.b, r.c) for r in t.collect()) == [(0, 1, 4), (0, 3, 4), (1, 2, 4), (2, 3, 4)]
    assert mesh.edges(t).count() == 8
    assert sorted((r.a, r.b) for r in mesh.boundary(t).collect()) == [(0, 1), (0, 3), (1, 2), (2, 3)]
    assert {round(r.area, 9) for r in mesh.mean_area(t).collect()} == {0.25}


def test_divergence_by_hand(spark):
    fields = spark.createDataFrame([(4, 7, 12.5), (4, 9, 40.0), (5, 2, 20.0), (5, 3, 31.0), (5, 8, 6.0)], "tp int, pt int, area double")
    links = spark.createDataFrame([(4, 7, 3), (4, 9, 2)], "tp int, pt1 int, pt2 int")
    found = {(r.tp, r.pt): r.rate for r in mesh.divergence(fields, links, "area", 4.0).collect()}
    assert found == {(4, 7): 4.625, (4, 9): -5.0, (5, 3): 4.625, (5, 2): -5.0}


def test_loops_and_alpha(spark):
    rows = [(1, i, float(i % 4), float(i // 4)) for i in range(16)] + [(2, i, float(i), 0.0) for i in range(4)]
    t = mesh.delaunay(spark.createDataFrame(rows, "tp int, pt int, x double, y double"), 1.5)
    walk = [r.pt for r in mesh.longest_loop(mesh.loops(mesh.boundary(t))).orderBy("place").collect()]
    assert walk[0] == 0 and len(walk) == 12 and set(walk) == set(range(16)) - {5, 6, 9, 10}
    assert {(r.a, r.b) for r in mesh.alpha_shape(t, 0.8).collect()} == {(r.a, r.b) for r in mesh.boundary(t).collect()}
    assert mesh.alpha_shape(t, 0.1).count() == 0


def test_warp_there_and_back(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)) * 20 + 7)], "tp int, pt int, x double, y double")
    rim = mesh.sector_rim(points, 12)
    back = mesh.warped(mesh.warped(points, rim, 72), rim, 72, inverse=True)
    got, want = ({r.pt: (r.x, r.y) for r in df.collect()} for df in (back, points))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hull_of_small_sets(spark):
    rng = np.random.default_rng(8)
    sets = [[(0.0, 0.0)], [(0.0, 0.0), (0.0, 0.0)], [(float(i), float(2 * i)) for i in range(5)], [(float(a), float(b)) for a in range(4) for b in range(4)], [tuple(map(float, v)) for v in rng.integers(0, 9, (60, 2))]]
    sets.append([(float(np.cos(a)), float(np.sin(a))) for a in np.linspace(0, 6.2, 40)])
    rows = [(t, i, x, y) for t, s in enumerate(sets) for i, (x, y) in enumerate(s)] + [(0, 9, None, 1.0)]
    got = {}
    for r in mesh.hull(spark.createDataFrame(rows, "tp int, pt long, x double, y double")).collect():
        got.setdefault(r.tp, set()).add((r.x, r.y))
    def vertex(p, others):  # not within the span of directions to the others
        angles = sorted(np.arctan2(q[1] - p[1], q[0] - p[0]) for q in others if q != p)
        gaps = [b - a for a, b in zip(angles, [*angles[1:], angles[0] + 2 * np.pi], strict=True)] if angles else [7]
        return max(gaps) > np.pi + 1e-9
    assert got == {t: {p for p in s if vertex(p, set(s))} for t, s in enumerate(sets)}


@pytest.mark.parametrize("tile", [40, 2000])
def test_tiles_give_the_whole_frame(spark, monkeypatch, tile):
    """Tiles with sure and unsure triangles against one triangulation of the frame; long, thin and clustered frames."""
    monkeypatch.setattr(mesh, "TILE", tile)
    rng = np.random.default_rng(6)
    frames = {0: rng.random((700, 2)) * (100, 40), 1: rng.random((200, 2)) * (300, 1), 2: np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(30, 1, (150, 2)), [[15.0, -200.0]]]), 3: rng.random((2, 2))}
    rows = [(t, 2**40 + i, float(x), float(y)) for t, f in frames.items() for i, (x, y) in enumerate(f)]
    got = {}
    for r in mesh.delaunay(spark.createDataFrame(rows, "tp int, pt long, x double, y double"), 12.0).collect():
        got.setdefault(r.tp, set()).add((r.a - 2**40, r.b - 2**40, r.c - 2**40))
    for t, f in frames.items():
        found = mesh.triangulate(f)
        sides = np.stack([np.hypot(*(f[found[:, a]] - f[found[:, b]]).T) for a, b in ((0, 1), (1, 2), (0, 2))])
        want = set(map(tuple, found[(sides <= 12).all(0)].tolist()))
        assert len(want ^ got.get(t, set())) <= 2 + 0.002 * len(want), (t, len(want), len(got.get(t, set())))
