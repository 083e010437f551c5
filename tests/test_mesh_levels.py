"""A mesh whose sides may be as long as the frame: most points are settled in small tiles and never meet in one task."""

import numpy as np

from fieldtrace.operators import mesh


def test_few_points_meet_in_large_tiles(spark, monkeypatch):
    seen, real = [], mesh.written
    monkeypatch.setattr(mesh, "written", lambda df: seen.append(real(df)) or seen[-1])
    xy = np.random.default_rng(4).random((6000, 2))
    points = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "tp int, pt long, x double, y double")
    got = {(r.a, r.b, r.c) for r in mesh.delaunay(points, 10.0).collect()}
    late = [df for df in seen if {"kind", "side"} <= set(df.columns)]
    assert len(late) == 1 and late[0].count() < 6000 / 4
    # 2 n - 2 - h triangles, h of them at the hull, whose sides have one triangle each
    sides = np.sort(np.array(sorted(got))[:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), 1)
    _, times = np.unique(sides, axis=0, return_counts=True)
    assert times.max() == 2 and len(got) == 2 * 6000 - 2 - (times == 1).sum()
