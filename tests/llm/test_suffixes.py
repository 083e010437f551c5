import random
from collections import defaultdict
from hashlib import sha256

import numpy as np

from fieldtrace.llm import suffixes


def plain(rows):
    least = defaultdict(lambda: None)
    for k, text in rows:
        data = (text or "").encode()
        if k is not None:
            for i in range(len(data) - 49):
                w = data[i : i + 50]
                least[w] = k if least[w] is None else min(least[w], k)
    out = []
    for k, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        if k is not None:
            for i in range(len(data) - 49):
                if least[data[i : i + 50]] < k:
                    gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        edges = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(data) else 0
        out.append((k, len(data), int(gone.sum()), edges, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, depth = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        s = rng.integers(1, int(rng.integers(2, 5)), n)
        order = np.argsort(suffixes.suffix_order(s, depth), kind="stable")
        keys = [tuple(s[i : i + depth].tolist()) for i in order]
        assert keys == sorted(keys)


def test_removal(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        got = sorted((tuple(r) for r in suffixes.substring_removal(df).collect()), key=str)
        assert got == plain([(r.doc_id, r.text) for r in df.collect()])
    assert suffixes.substring_removal(empty).count() == 0


def test_dense_repeats_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rng = random.Random(2)
    core = "".join(rng.choice("abcd ") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(120))) + core[rng.randrange(30) : 90 - rng.randrange(20)] + "".join(rng.choice("ab") for _ in range(rng.randrange(900)))) for i in range(40)]
    rows += [(41, "ab" * 600), (42, "ab" * 300), (43, "b" * 400), (44, "b" * 49), (45, "b" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffixes.substring_removal(df).collect()), key=str)
    assert got == plain(rows)


def test_texts_lose_what_repeats(spark, odd):
    kept = suffixes.without_repeats(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    rows = {(r.doc_id, r.text) for r in kept.collect()}
    assert (4, "same text of some words " * 30) in rows and not any(k == 5 and t and t.startswith("same text of") for k, t in rows)
    assert (2, None) in rows and (1, "") in rows


def test_columns_of_any_name(spark):
    text = "a passage of well over fifty bytes that two documents have in full"
    rows = [(1, text, "x", 1, ("p", 2)), (2, f"{text} and more", None, None, None), (2, f"{text} and more", None, None, None), (None, None, "y", 3, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `my col` string, `n.chars` long, rest struct<`a b`:string,`c.d`:int>").withColumnRenamed("rest", "tick`ed")
    got = suffixes.without_repeats(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted((r.text or "", r["my col"] or "", r["n.chars"] or 0) for r in got.collect()) == [("", "y", 3), (" and more", "", 0), (" and more", "", 0), (text, "x", 1)]
    assert [tuple(r[4]) for r in got.filter("doc_id = 1").collect()] == [("p", 2)]
    assert suffixes.without_repeats(df.limit(0)).count() == 0
