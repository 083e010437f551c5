import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import colony, groups, persistence, timelines

POINTS = "track string, tp int, t double, x double, y double"


def walk(n, heading):
    """Steps of one length whose heading is a function of the step."""
    angle = np.radians([heading(k) for k in range(n - 1)])
    x, y = np.r_[0, np.cumsum(np.cos(angle))], np.r_[0, np.cumsum(np.sin(angle))]
    return [(k, float(k), float(x[k]), float(y[k])) for k in range(n)]


def test_straight_and_turning_tracks(spark):
    own = {"straight": walk(20, lambda k: 30.0), "round": walk(30, lambda k: 40.0 * k), "turned": walk(40, lambda k: 0.0 if k < 20 else 40.0 * k), "short": walk(4, lambda k: 0.0)}
    points = spark.createDataFrame([(t, *p) for t, rows in own.items() for p in rows], POINTS)
    chain = persistence.timeline(points, smooth=0)
    runs = {}
    for r in persistence.stretches(chain).collect():
        runs.setdefault(r.track, []).append((r.start, r.stop))
    assert runs["straight"] == [(0, 78)] and "short" not in runs
    assert all(b < 16 or a > 104 for a, b in runs["round"])  # at its ends a track goes on along the first and last window's line
    assert runs["turned"][0][0] == 0 and 60 <= runs["turned"][0][1] <= 84 and all(a > 140 for a, _ in runs["turned"][1:])
    wave = {(r.track, r.tp): r for r in persistence.waveform(chain).collect()}
    assert sum(r.persistent for (t, _), r in wave.items() if t == "straight") == 78 and wave["straight", 5].waveform == pytest.approx(1.0) and wave["round", 50].waveform is None
    at = {r.track: (r.persistent, r.quiescent) for r in persistence.persistence_at(chain, 4.0, 4.0).collect()}
    assert at["straight"] == (1.0, 0.0) and at["round"][0] < 0.2
    sampled = {(r.track, r.time): r.waveform for r in persistence.sampled_waveform(chain, [0.0, 5.0, 50.0]).collect()}
    assert sampled["straight", 0.0] == pytest.approx(1.0) and sampled["straight", 50.0] is None and sampled["straight", 5.0] == pytest.approx(1.0) and len(sampled) == 9
    island = {r.track: r for r in persistence.islands(chain, persistence.stretches(chain)).collect()}["straight"]
    assert island.duration == pytest.approx(19.0) and island.distance == pytest.approx(19.0) and island.speed == pytest.approx(1.0) and island.gap is None


def test_radial_significance(spark):
    rng = np.random.default_rng(4)
    radius = rng.uniform(0, 1.05, 90)
    values = np.where(radius > 0.8, 3.0, 0.0) + rng.normal(0, 1, 90)
    rows = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(radius, values, strict=True)] + [(None, 5.0, 1.0)], "radius double, speed double, area double")
    got = {(r.bin1, r.bin2): r for r in colony.radial_significance(rows, ("speed", "area")).collect()}
    edges = groups.bin_edges(3, True)
    bins = [values[(radius >= a) & (radius < (1.1 if i == 2 else b))] for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    names = [f"{a:.2f}-{b:.2f}" for a, b in zip(edges, edges[1:], strict=False)]
    found = []
    for i in range(3):
        for j in range(i + 1, 3):
            a, b = bins[i], bins[j]
            df = len(a) + len(b) - 2
            pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / df
            t = (a.mean() - b.mean()) / np.sqrt(pooled * (1 / len(a) + 1 / len(b)))
            row = got[names[i], names[j]]
            assert row.name == "speed" and row.statistic == pytest.approx(t) and row.df == df and row.p == pytest.approx(groups.student_p(t, df))
            found.append((row.p, row.adjusted))
    worst = 0.0
    for k, (p, adjusted) in enumerate(sorted(found)):
        worst = max(worst, min(1.0, (3 - k) * p))
        assert adjusted == pytest.approx(worst)
    assert len(got) == 3 and colony.radial_significance(rows, ("speed",), alpha=1e-6).count() == sum(a <= 1e-6 for _, a in found)


def test_errors_and_checks(spark):
    frames = spark.range(5).withColumnRenamed("id", "tp")
    tracks = spark.createDataFrame([(1, t) for t in range(5)] + [(2, 0)], "track long, tp long")
    stacks = spark.createDataFrame([("a", 4, 5), ("b", 4, 5)], "stack string, rows int, cols int")
    assert timelines.check_alignment(frames, tracks, stacks) == 5
    with pytest.raises(ValueError):
        timelines.check_alignment(frames.limit(3), tracks, stacks)
    with pytest.raises(ValueError):
        timelines.check_alignment(frames, tracks, stacks.union(spark.createDataFrame([("c", 4, 6)], stacks.schema)))
    files, meta = spark.createDataFrame([("f", 1), ("g", 3)], "file string, tile int"), spark.createDataFrame([(0, "s"), (1, "r")], "index int, site string")
    assert [r.site for r in timelines.with_tile_metadata(files.filter("tile = 1"), meta).collect()] == ["s"]
    with pytest.raises(Exception, match="no metadata of tile 3"):
        timelines.with_tile_metadata(files, meta).collect()
    kinds = [spark.createDataFrame([(1, f"{k}1"), (2, f"{k}2")][: 2 - (k == "t")], "tile int, path string") for k in "ita"]
    assert [tuple(r) for r in timelines.tile_inputs(*kinds).collect()] == [(1, "i1", "t1", "a1")]
    with pytest.raises(KeyError):
        timelines.tile_inputs(kinds[0].union(kinds[0]), *kinds[1:])
    with pytest.raises(Exception, match="differ in length"):
        timelines.tracks_from_arrays(spark.createDataFrame([("a", [0.0], [1.0, 2.0], [1.0])], "track string, t array<double>, x array<double>, y array<double>")).collect()


def test_density_area_by_simpson(spark):
    for n in (101, 100):
        at = np.linspace(0, 2, n)
        rows = spark.createDataFrame([(k, float(v), float(v**2)) for k, v in enumerate(at)], "place int, at double, density double")
        got = timelines.scaled_density(rows, 8 / 3).orderBy("place").collect()
        assert got[-1].density == pytest.approx(4.0) and not any(r.peak for r in got)  # both rules are exact for a parabola
    bump = timelines.scaled_density(spark.createDataFrame([(k, float(k), float(v)) for k, v in enumerate([0, 2, 1, 3, 0])], "place int, at double, density double")).filter("peak").collect()
    assert [r.place for r in bump] == [1, 3] and timelines.scaled_density(rows.filter(F.lit(False))).count() == 0
