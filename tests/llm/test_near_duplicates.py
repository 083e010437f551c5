import random
import re

import numpy as np
import xxhash

from fieldtrace.llm import simhash
from fieldtrace.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(rows):
    fps = [(k, plain_fingerprint(t)) for k, t in rows]
    label = {f: f for _, f in fps}
    distinct = sorted(label)

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = {}
    for k, f in fps:
        if k is not None:
            least[root(f)] = min(k, least.get(root(f), k))
    return sorted(((k, f"{f:016x}", least.get(root(f))) for k, f in fps), key=str)


def test_groups(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        got = sorted((tuple(r) for r in simhash.simhash_groups(df).collect()), key=str)
        assert got == plain_groups([(r.doc_id, r.text) for r in df.collect()])
    assert simhash.simhash_groups(empty).count() == 0


def test_hierarchy_finds_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(30)})
    fps = np.array(values, np.uint64)
    for sizes in ([len(values)], [1, 2, 3, 17, 260, len(values) - 283]):
        node = np.repeat(np.arange(len(sizes)), sizes)
        found = [tuple(sorted(p)) for a, b in simhash.near_pairs(node, fps) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(set(found))
        assert set(found) == {(i, j) for j in range(len(values)) for i in range(j) if node[i] == node[j] and (values[i] ^ values[j]).bit_count() <= 2}


def test_hot_nodes_are_split(spark):
    rng = random.Random(6)
    values = sorted({rng.getrandbits(20) | 5 << 40 for _ in range(300)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")

    def closure(edges):
        label = {v: v for v in values}
        def root(f):
            while label[f] != f:
                f = label[f]
            return f
        for a, b in edges:
            label[root(a)] = root(b)
        groups = {}
        for v in values:
            groups.setdefault(root(v), []).append(v)
        return sorted(groups.values())

    got = [tuple(r) for r in simhash.links(df, node=20).collect()]
    assert closure(got) == closure([(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = [r.doc_id for r in simhash.first_of_group(odd).collect()]
    assert simhash.first_of_group(odd).columns == odd.columns
    assert kept.count(None) == 2 and len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
    roots = {r.component_id for r in simhash.simhash_groups(odd).collect()}
    assert {k for k in kept if k is not None} == roots - {None}


def test_groups_of_an_empty_table(spark, empty):
    assert simhash.first_of_group(empty).count() == 0 and simhash.first_of_group(empty).columns == empty.columns


def test_clashing_names_of_columns(spark):
    names = "_id _source _size _a _b _d _t row id twin gone again k t first fp size text doc_id source".split()
    rows = [(*[7] * 17, "some words of a text " * 12 + str(i // 2), i, "s") for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    kept = simhash.first_of_group(df)
    assert kept.columns == names and all(r.gone == 7 and r.twin == 7 for r in kept.collect())
    from fieldtrace.llm import mixing

    assert mixing.mixed(df).columns == names and all(r.size == 7 for r in mixing.mixed(df).collect())
