import numpy as np
import pytest

from fieldtrace.operators import polygons, rasters, splines, tolerance

PIXELS = "image string, row int, col int, value double"


def pixels_of(spark, **images):
    return spark.createDataFrame([(n, i, j, float(v)) for n, a in images.items() for (i, j), v in np.ndenumerate(np.asarray(a))], PIXELS)


def array_of(rows, column="value"):
    out = {}
    for r in rows:
        out.setdefault(r["image"], {})[r["row"], r["col"]] = r[column]
    return out


def test_distances_equal_all_marks(spark, monkeypatch):
    monkeypatch.setattr(rasters, "BAND", 3)
    rng = np.random.default_rng(5)
    sizes = {"a": (9, 17), "b": (4, 1), "c": (6, 6), "d": (20, 3)}
    marks = {"a": [(0, 0), (8, 16), (4, 4), (4, 5)], "b": [(3, 0)], "c": [], "d": [(int(rng.integers(20)), int(rng.integers(3))) for _ in range(5)]}
    images = spark.createDataFrame([(n, *s) for n, s in sizes.items()], "image string, rows int, cols int")
    marked = spark.createDataFrame([(n, i, j) for n, own in marks.items() for i, j in own] + [("a", 50, 50)], "image string, row int, col int")
    got = array_of(rasters.distance_map(images, marked, 0.7, 1.9).collect(), "distance")
    for n, (rows, cols) in sizes.items():
        for i in range(rows):
            for j in range(cols):
                want = min((np.hypot((i - a) * 0.7, (j - b) * 1.9) for a, b in marks[n]), default=None)
                assert got[n][i, j] == (None if want is None else pytest.approx(want)), (n, i, j)
    peaks = array_of(rasters.peak_map(images, marked, 8, 8, 8).collect())
    assert peaks["a"][0, 0] == 1 and peaks["a"][0, 1] == 0 and set(peaks["c"].values()) == {0.0}


def plain_adaptive(a, size, clip, levels=256):
    lo, hi = a.min(), a.max()
    a = (a - lo) / (hi - lo) if hi > lo else (a > 0).astype(float)
    level = np.minimum(np.floor(a * levels), levels - 1).astype(int)
    tiles = [-(-n // size) for n in a.shape]
    share = {}
    for r in range(tiles[0]):
        for c in range(tiles[1]):
            own = level[r * size : (r + 1) * size, c * size : (c + 1) * size].ravel()
            n = np.bincount(own, minlength=levels).astype(float)
            kept = np.minimum(n, max(1, np.floor(clip * len(own))))
            share[r, c] = np.cumsum(kept + (len(own) - kept.sum()) / levels) / len(own)
    out = np.zeros(a.shape)
    for (i, j), k in np.ndenumerate(level):
        pr, pc = (i + 0.5) / size - 0.5, (j + 0.5) / size - 0.5
        for di in (0, 1):
            for dj in (0, 1):
                w = abs(1 - di - (pr - np.floor(pr))) * abs(1 - dj - (pc - np.floor(pc)))
                at = [int(min(max(np.floor(p) + d, 0), t - 1)) for p, d, t in ((pr, di, tiles[0]), (pc, dj, tiles[1]))]
                out[i, j] += w * share[at[0], at[1]][k]
    return out


def test_adaptive_and_percentile_contrast(spark):
    rng = np.random.default_rng(1)
    images = {"a": rng.integers(0, 40, (13, 22)), "b": np.full((5, 5), 3.0), "c": rng.normal(0, 1, (8, 8))}
    df = pixels_of(spark, **images)
    got = array_of(rasters.adaptive_contrast(df, 4, 0.2).collect())
    flat = array_of(rasters.percentile_contrast(df).collect())
    for n, a in images.items():
        want = plain_adaptive(np.asarray(a, float), 4, 0.2)
        assert all(v == pytest.approx(want[k]) for k, v in got[n].items()) and len(got[n]) == a.size
        x = (a - a.min()) / max(a.max() - a.min(), 1e-9)
        lo, hi = np.percentile(x, [2, 98])
        assert all(v == pytest.approx(0.0 if n == "b" else np.clip((x[k] - lo) / (hi - lo), 0, 1)) for k, v in flat[n].items())


def test_erosion_and_margins(spark):
    a = np.zeros((9, 12))
    a[2:7, 3:9] = 1
    a[0, 11] = 1
    df, images = pixels_of(spark, a=a), spark.createDataFrame([("a", 9, 12)], "image string, rows int, cols int")
    assert {(r.row, r.col) for r in rasters.eroded(df.filter("value > 0")).collect()} == {(i, j) for i in range(3, 6) for j in range(4, 8)}
    bounds = lambda **k: {(r.row, r.col) for r in rasters.trimmed(df, images, **k).collect()}
    box = lambda r0, r1, c0, c1: {(i, j) for i in range(r0, r1) for j in range(c0, c1)}
    assert bounds() == box(0, 7, 3, 12) and bounds(erode=1) == box(3, 6, 4, 8) and bounds(erode=2) == box(4, 5, 5, 7)
    assert bounds(erode=1, padding=2) == box(1, 8, 2, 10) and bounds(erode=1, padding=9) == box(0, 9, 0, 12)
    assert bounds(erode=1, axes=("row",)) == box(3, 6, 0, 12) and bounds(erode=1, symmetric=("row", "col")) == box(3, 6, 4, 8)
    assert bounds(symmetric=("row",)) == box(0, 9, 3, 12) and bounds(symmetric=("row", "col")) == box(0, 9, 0, 12) and bounds(erode=5) == set()


def test_near_annotations(spark):
    rows = [(1, "f", "c", 0.99999999, 0.0, 2.0, 2.0), (2, "f", "c", 1.00000099, 0.0, 2.0, 2.0), (3, "f", "d", 1.0, 0.0, 2.0, 2.0), (4, "g", "c", 1.0, 0.0, 2.0, 2.0), (5, "f", "c", 2.0, 2.0, 1.0, 0.0), (6, "f", "c", 1.0, 0.0, 1.000001, 2.0), (7, None, "c", 1.0, 0.0, 2.0, 2.0), (8, None, "c", 1.0, 0.0, 2.0, 2.0)]
    boxes = spark.createDataFrame(rows, "o int, file string, sel_class string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.o for r in tolerance.distinct_boxes(boxes, "o").collect()) == [1, 3, 4, 7]
    steps = spark.createDataFrame([(i, "f", "c", i * 8e-6, 0.0) for i in range(7)], "o int, file string, sel_class string, x double, y double")
    assert sorted(r.o for r in tolerance.distinct_points(steps, "o").collect()) == [0, 2, 4, 6]  # near only to one that went
    turns = [(1, "f", "c", 0.0, 0.0, 1.0, 2.0, 0.25), (2, "f", "c", 0.0, 0.0, 2.0, 1.0, 0.25 + np.pi / 2 - 2 * np.pi), (3, "f", "c", 0.0, 0.0, 2.0, 1.0, 0.25), (4, "f", "c", 0.0, 0.0, 2.0, 0.0, 0.25)]
    ellipses = spark.createDataFrame(turns, "o int, file string, sel_class string, x double, y double, a double, b double, angle double")
    got = {r.o: r for r in tolerance.distinct_ellipses(ellipses, "o").collect()}
    assert set(got) == {1, 3} and got[1].a == 2.0 and got[1].angle == pytest.approx(0.25 + np.pi / 2)
    old = steps.filter("o >= 5")
    assert sorted(r.o for r in tolerance.appended(old, steps.filter("o < 5"), tolerance.POINT, "o").collect()) == [0, 2, 5]
    assert tolerance.exists(boxes, "g") and not tolerance.exists(boxes, "h") and tolerance.found(boxes, "f").count() == 5


def random_walk(draw, n):
    return np.cumsum(draw.integers(1, 4, n)).astype(float), np.cumsum(draw.normal(0, 2, n))


def test_splines_equal_a_dense_solve(spark):
    draw = np.random.default_rng(9)
    for n, bound in ((4, 0.0), (9, 3.0), (30, 30.0), (12, 1e9)):
        t, y = random_walk(draw, n)
        values, second = splines.smoothed(t, y, bound)
        h = np.diff(t)
        q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
        for j in range(n - 2):
            q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
            r[j, j] = (h[j] + h[j + 1]) / 3
            if j:
                r[j, j - 1] = r[j - 1, j] = h[j] / 6
        residual = ((y - values) ** 2).sum()
        if bound > 1e8:
            line = np.polyval(np.polyfit(t, y, 1), t)
            assert np.allclose(values, line) and not second.any()
            continue
        assert residual == pytest.approx(bound, abs=1e-6)
        assert np.allclose(q.T @ values, r @ second[1:-1], atol=1e-7)  # a natural cubic spline
        if bound:
            g = np.linalg.lstsq(q, y - values, rcond=None)[0]  # residuals are a multiple of Q times the second derivatives
            weight = (g @ second[1:-1]) / (second[1:-1] @ second[1:-1])
            assert weight > 0 and np.allclose(np.linalg.solve(r + weight * q.T @ q, q.T @ y), second[1:-1], atol=1e-6)
        fine = np.linspace(t[0] - 1, t[-1] + 1, 200)
        got = splines.at_times(t, values, second, fine)
        assert np.allclose(splines.at_times(t, values, second, t), values) and got[0] == pytest.approx(values[0]) and got[-1] == pytest.approx(values[-1])


def test_regular_tracks(spark):
    rows = [("a", float(t), 2.0 * t, -1.0 * t) for t in (0, 1, 3, 4, 7)] + [("b", 0.0, 1.0, 1.0)] * 5 + [("c", 1.0, None, 2.0)] + [("d", float(t), float(t % 2), 0.0) for t in range(5)]
    got = {}
    for r in splines.regular_tracks(spark.createDataFrame(rows, "track string, t double, x double, y double"), 2.0, 0.0).collect():
        got.setdefault(r.track, {})[r.place] = (r.t, r.x, r.y)
    assert set(got) == {"a", "d"} and [got["a"][k] for k in range(5)] == [pytest.approx((t, 2 * min(t, 7), -min(t, 7))) for t in (0, 2, 4, 6, 8)]
    assert got["d"][1] == pytest.approx((2.0, 0.0, 0.0))


def test_polygon_delta_by_hand(spark):
    """A triangle of neighbours doubles its sides; the fourth neighbour has no link."""
    first = {0: (0.3, 0.3), 1: (0.0, 0.0), 2: (0.0, 1.0), 3: (1.0, 1.0), 4: (5.0, 5.0)}
    second = {10: (0.5, 0.5), 11: (0.1, 0.1), 12: (0.1, 2.1), 13: (2.1, 2.1)}
    points = spark.createDataFrame([(0, k, *p) for k, p in first.items()] + [(1, k, *p) for k, p in second.items()], "tp int, pt long, x double, y double")
    edges = spark.createDataFrame([(0, 0, k) for k in (1, 2, 3, 4)] + [(1, 10, k) for k in (11, 12)], "tp int, a long, b long")
    links = spark.createDataFrame([(0, k, 10 + k) for k in range(4)], "tp int, pt1 long, pt2 long")
    rows = polygons.polygon_delta(points, edges, links).collect()
    assert [(r.pt1, r.pt2, r.n_forward, r.n_backward) for r in rows] == [(0, 10, 3, 0)]
    assert rows[0].divergence == pytest.approx(np.log(2.0)) and rows[0].turn == pytest.approx(0.0)
    assert sorted((round(p.x, 6), round(p.y, 6)) for p in rows[0].ring) == [(0.05, 0.05), (0.05, 1.55), (1.55, 1.55)]
    more = edges.union(spark.createDataFrame([(1, 10, 13)], "tp int, a long, b long"))
    row = polygons.polygon_delta(points, more, links).first()
    assert (row.n_forward, row.n_backward) == (3, 3) and row.divergence == pytest.approx(np.log(2.0)) and len(row.ring) == 3
