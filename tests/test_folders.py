from pathlib import Path

import pytest

from fieldtrace.sources import folders

NAMES = ["EGFP-s01t002.tif", "gfp-s01z2t002m1.tif", "gfp-s01z1t002m2.tif", "gfp-s01z1t002m1.tif", "exp_s2t3mcherry_w2_ORG.tif", "exp-007_s4c2_ORG.tif", "notes.txt", "strange.tif", ".EGFP-s09t009.tif"]


def touch(root, *names):
    for n in names:
        p = Path(root, n)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 10)


@pytest.fixture
def tree(tmp_path):
    touch(tmp_path / "data set", *[f"tile01/{n}" for n in NAMES[:4]], *[f"tile02/{n}" for n in NAMES[4:]], ".hidden/EGFP-s03t001.tif", "train/001cell.png", "train/001dots.png", "train/002cell.png")
    return str(tmp_path / "data set")


def test_listing_reads_no_contents(spark, tree, capsys):
    files = folders.images(spark, tree)
    names = {r.name: r for r in files.collect()}
    assert set(names) == {*NAMES[:6], "strange.tif", "001cell.png", "001dots.png", "002cell.png"}
    assert names["EGFP-s01t002.tif"].length == 10 and names["EGFP-s01t002.tif"].folder == "tile01" and names["EGFP-s01t002.tif"].stem == "EGFP-s01t002"
    files.explain()
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[-1]


def test_groups_have_sorted_members(spark, tree):
    got = {(r.channel_name, r.tile, r.timepoint): r for r in folders.catalog(folders.images(spark, tree)).collect()}
    group = got["gfp", 1, 2]
    assert group.n == 3 and [(m["slice"], m.multi_tile) for m in group.members] == [(1, 1), (1, 2), (2, 1)] and group.suffix == ".tif"
    assert got["EGFP", 1, 2].n == 1 and {k[1:] for k in got} >= {(2, 3), (4, 7)}
    only = folders.catalog(folders.images(spark, tree), channel="E-gfp").collect()
    assert [(r.channel_name, r.tile, r.timepoint) for r in only] == [("EGFP", 1, 2)]


def test_two_files_of_one_record(spark, tree):
    touch(tree, "tile03/EGFP-s01t002.tif")
    with pytest.raises(KeyError):
        folders.catalog(folders.images(spark, tree))


def test_any_names_count_in_their_folder(spark, tree):
    got = {(r.tile, r.timepoint): r.n for r in folders.catalog(folders.images(spark, tree), any_name=True).collect()}
    assert got == {("tile01", k): 1 for k in range(1, 5)} | {("tile02", k): 1 for k in range(1, 4)} | {("train", k): 1 for k in range(1, 4)}


def test_masks_and_tiles(spark, tree):
    files = folders.images(spark, tree)
    got = folders.with_mask(folders.training_images(files), folders.training_masks(files)).collect()
    assert [(r.name, r.mask.rpartition("/")[2]) for r in got] == [("001cell.png", "001dots.png")]
    assert {(r.tile, r.n) for r in folders.tile_folders(files).collect()} == {(1, 4), (2, 3)}
    touch(tree, "other/001dots.png")
    files = folders.images(spark, tree)
    with pytest.raises(KeyError):
        folders.with_mask(folders.training_images(files), folders.training_masks(files))
