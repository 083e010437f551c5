"""Simulation, split, index and summary files, and the store of grid tables."""

import json

import pytest

from fieldtrace.sources import grids, textfiles


def test_simulation_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("t\tid\tx\ty\ta\tb\tc\n0\t1\t2.5\t3\t0\t0\t0\n1\t1\t3.5\t4\t0\t0\t0\n")
    got = textfiles.read_simulation(spark, f"file://{tmp_path}/a.tsv").drop("file").collect()
    assert sorted(map(tuple, got)) == [(0.0, 1, 2.5, 3.0), (1.0, 1, 3.5, 4.0)]
    (tmp_path / "b.tsv").write_text("1\t2\t3\n")
    with pytest.raises(Exception, match="not seven fields"):
        textfiles.read_simulation(spark, f"file://{tmp_path}/b.tsv").collect()


def test_splits_and_indices(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["/d/a-001.png", "/d/a-002.png"], "test": ["/e/b-t017.png", "/e/none.png"]}))
    splits = textfiles.read_splits(spark, f"file://{tmp_path}/s.json")
    assert sorted(map(tuple, splits.collect()), key=str) == [("test", "/e/b-t017.png", 17), ("test", "/e/none.png", None), ("train", "/d/a-001.png", 1), ("train", "/d/a-002.png", 2)]
    assert [tuple(r) for r in textfiles.outside(splits, "/d").collect()] == [("test", 2)]
    textfiles.write_splits(splits, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 4
    (tmp_path / "i.csv").write_text("experiment,tile,cell\ne1,1,5\ne1,2,6\n")
    assert textfiles.read_index(spark, f"file://{tmp_path}/i.csv", ["experiment", "tile"]).count() == 2
    with pytest.raises(ValueError, match="several rows"):
        textfiles.read_index(spark, f"file://{tmp_path}/i.csv", ["experiment"])
    textfiles.write_table(splits, f"file://{tmp_path}/table", "_dist")
    assert spark.read.csv(f"file://{tmp_path}/table_dist", header=True).columns == ["split", "file", "number"]


def test_grid_store(spark, tmp_path):
    rows = [(t, i, p, p, float(p), 2.0) for t in ("a", "b") for i in range(3) for p in range(4)]
    points = spark.createDataFrame(rows, "tile string, tp int, pt int, track int, x double, y double")
    links = spark.createDataFrame([("a", 0, 1, 1)], "tile string, tp int, pt1 int, pt2 int")
    grids.save({"points": points, "links": links}, f"file://{tmp_path}/g")
    back = grids.load(spark, f"file://{tmp_path}/g", "points", points.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    some = grids.load(spark, f"file://{tmp_path}/g", "points", ["pt", "x"], tile="b", first=1, last=1)
    assert sorted(map(tuple, some.collect())) == [(p, float(p)) for p in range(4)]
    assert "PartitionFilters: [isnotnull(tile" in some._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="links has no"):
        grids.save({"links": points}, f"file://{tmp_path}/h")
