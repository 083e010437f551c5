"""Round trips of point and track files."""

import pytest

from fieldtrace.sources import textfiles


def test_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#point_x,point_y,point_score\n0.5, 0.25 ,1 # note\n\n1,2,3\n")
    got = textfiles.read_points(spark, f"file://{tmp_path}/a.csv")
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0.5, 0.25, 1.0), (1.0, 2.0, 3.0)]
    textfiles.write_points(got, f"file://{tmp_path}/out", x_range=(0, 0.5))
    assert [tuple(r)[1:] for r in textfiles.read_points(spark, f"file://{tmp_path}/out").collect()] == [(0.5, 0.25, 1.0)]
    (tmp_path / "b.csv").write_text("1,2\n")
    with pytest.raises(Exception, match="not three values"):
        textfiles.read_points(spark, f"file://{tmp_path}/b.csv").collect()


def test_tracks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# tracks\nTrack000\n1,2,3\n0.5,1,2\n1,1,1\n\nTrack001\n4 # one\n1\n2\n")
    got = textfiles.read_tracks(spark, f"file://{tmp_path}/a.csv").drop("file")
    want = [(0, 0, 1, 0.5, 1.0), (0, 1, 2, 1.0, 1.0), (0, 2, 3, 2.0, 1.0), (1, 0, 4, 1.0, 2.0)]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert textfiles.read_tracks(spark, f"file://{tmp_path}/a.csv", min_len=2).count() == 3
    textfiles.write_tracks(got, f"file://{tmp_path}/out")
    back = textfiles.read_tracks(spark, f"file://{tmp_path}/out").drop("file", "track")
    assert sorted(tuple(r) for r in back.collect()) == sorted(w[1:] for w in want)


def test_curves(spark, tmp_path):
    curve = spark.createDataFrame([(0.9, 1, 0, 0.5, 0.0, 1.0), (0.4, 2, 1, 1.0, 0.5, 2 / 3)], "score double, tp long, fp long, tpr double, fpr double, precision double")
    textfiles.write_curve(curve, f"file://{tmp_path}/full", {"detector": "a", "iterations": 5})
    textfiles.write_curve(curve, f"file://{tmp_path}/plot", plot_only=True)
    back, data = textfiles.read_curve(spark, f"file://{tmp_path}/full")
    assert sorted(back.collect()) == sorted(curve.collect()) and {tuple(r) for r in data.collect()} == {("detector", "a"), ("iterations", "5")}
    plot, data = textfiles.read_curve(spark, f"file://{tmp_path}/plot")
    assert {(r.score, r.tp, r.precision) for r in plot.collect()} == {(0.9, None, 1.0), (0.4, None, 2 / 3)} and data.count() == 0
