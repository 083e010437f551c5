"""The corpus pipeline: every stage against a plain version of its rule on what the stage before kept."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fieldtrace.llm import mixing, packing, toxicity  # noqa: E402

from .test_near_duplicates import plain_groups  # noqa: E402
from .test_packing_and_warc import check_pack  # noqa: E402
from .test_suffixes import plain  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    docs, labels = [], []
    for i in range(260):
        bad = i % 9 == 0
        own = text(rng.randrange(20, 200)) + " nasty vile rotten awful" * bad + (" " + passage if i % 13 == 1 else "")
        docs.append((i, own, "en", f"s{i % 4}", len(own)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs += [(300 + i, docs[1][1], "en", "s1", 1) for i in range(5)] + [docs[5]] * 2
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, "a text without an id " * 9, "en", "s2", 1), (402, "ü" * 90, "de", None, 90)]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tables):
    docs, kept = spark.read.parquet(f"{tables}/documents.parquet"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), stage(spark, before, tables).schema)
        kept[name] = rows_of(docs)
        if name != "packing":
            assert docs.columns == names and docs.dtypes == before.dtypes
        rows = rows_of(before)
        if name == "toxicity":
            labels = spark.read.parquet(f"{tables}/labels.parquet")
            bad = {r.doc_id for r in toxicity.toxic_scores(before, labels).collect() if r.predicted}
            assert sorted(kept[name], key=str) == sorted((r for r in rows if r[0] not in bad), key=str)
            planted = {i for i in range(260) if i % 9 == 0}
            assert len(bad & planted) >= 0.9 * len(planted) and len(bad - planted) <= 5
        elif name == "simhash":
            group = {}
            for k, f, c in plain_groups([(r[0], r[1]) for r in rows]):
                group.setdefault(c, set()).add(k)
            want = sorted(min(g - {None}) for g in group.values() if g - {None})
            assert sorted(r[0] for r in kept[name] if r[0] is not None) == want
            assert [r[1] for r in kept[name] if r[0] is None] == [r[1] for r in rows if r[0] is None]
        elif name == "suffix_array":
            left = {k: n - gone for k, n, gone, _, _ in plain([(r[0], r[1]) for r in rows])}
            assert {r[0]: len((r[1] or "").encode()) for r in kept[name]} == {k: n for k, n in left.items() if n or not next(r[1] for r in rows if r[0] == k)}
        elif name == "mixing":
            plan = {(r.doc_id, r.size): r.taken for r in mixing.mix_words(before).collect()}
            taken = {}
            for r in kept[name]:
                taken[r[0]] = taken.get(r[0], 0) + len(r[1].split())
            assert taken == {k: n for (k, _), n in plan.items() if n}
        else:
            assert check_pack(docs.collect(), [(r[0], r[1]) for r in rows]) > 0.9
            assert len({(r.doc_id, r.start, r.doc_tokens, r.ids_crc32, r.copy) for r in docs.collect()}) == docs.count()


def test_run_is_the_stages_in_turn(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    key = lambda r: (r.doc_id, r.start, r.ids_crc32, r.copy)
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, docs.collect()), key=str)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == packing.packed(spark.createDataFrame([], SCHEMA), with_ids=True).columns
