"""A radius instead of edges gives the same means over neighbours, without making an edge."""

import numpy as np

from fieldtrace.operators import imputation, mesh, spatial


def test_radius_equals_its_edges(spark):
    draw = np.random.default_rng(6)
    rows = [(k % 3, k, float(x), float(y)) for k, (x, y) in enumerate(draw.integers(0, 40, (240, 2)) / 2)] + [(1, 900, None, 1.0)]
    points = spark.createDataFrame(rows, "tp int, pt long, x double, y double")
    links = spatial.nearest_links(points, spatial.earlier(points), 1.2)
    edges = spatial.radius_edges(points, 3.0)
    keys = {"tp", "pt", "forward", "source", "n"}
    plain = lambda df: sorted(tuple(v if c in keys else round(v, 9) for c, v in r.asDict().items()) for r in df.collect())
    for f in (lambda e: mesh.rotation(points, e, links), lambda e: mesh.imputed(points, e, links), lambda e: imputation.made_points(points, e, links)):
        got, want = f(3.0), f(edges)
        assert plain(got) == plain(want) and len(plain(got)) > 5
        assert "explode(pt1" not in got._jdf.queryExecution().toString() and "explode(pt1" in want._jdf.queryExecution().toString()
