import zlib

import pytest

from fieldtrace.llm import shards


def plain_version(rows, n=40):
    rows = sorted(((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows), key=lambda r: (r[0] is not None, *(x or 0 for x in r)))
    total, before, used, out = sum(r[1] for r in rows), 0, [0] * n, []
    for k, size, crc in rows:
        s = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((k, size, crc, "bytes", s, used[s], None))
        used[s] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [40, 3])
def test_whole_tables(spark, odd, empty, texts, n):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        got = sorted((tuple(r) for r in shards.shard_rows(df, n).collect()), key=str)
        assert got == sorted(plain_version([(r.doc_id, r.text) for r in df.collect()], n), key=str)
    assert shards.shard_rows(empty).count() == 0


def test_hot_id_is_split_and_sizes_are_near_equal(spark):
    rows = [(None, "x" * (i % 50)) for i in range(3000)] + [(i, "y" * 30) for i in range(6000)] + [(7, "same")] * 500
    got = shards.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_version(rows), key=str)
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(abs(v - mean) for v in sizes.values()) <= max(r.size for r in got)


def test_any_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(i % 3, i, "t", i) for i in range(60)], "doc_id long, size long, shard_of string, `my col` long")
    got = shards.balanced(df, ["doc_id", "my col"], "size", 4)
    assert set(got.columns) == {"doc_id", "size", "shard_of", "my col", "shard", "slot"} and got.count() == 60


def test_no_python_in_the_plan(spark, odd, capsys):
    shards.shard_rows(odd).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan
