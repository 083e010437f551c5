"""Toxicity: the risk against its definition, Spark against one machine, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from fieldtrace.llm import toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % toxicity.FOLDS == 0


@pytest.fixture(scope="module")
def corpus():
    """Two languages: one with ten insults, one whose insults share a stem; toxic texts are longer, so common words lean to them."""
    rng = random.Random(7)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    insults = (["nasty", "vile", "awful", "rotten"], ["kruzo" + x for x in ("la", "mi", "nent", "schaft", "ig", "un")])
    rows, labels = [], []
    for i in range(1500):
        bad, own = i % 7 == 0, insults[i % 3 == 0]
        text = [rng.choice(common) for _ in range(90 if bad else 50)] + [rng.choice(own) for _ in range(3)] * bad
        rng.shuffle(text)
        rows.append((i, " ".join(text).capitalize(), int(bad)))
        if i % 4 < 2:
            labels.append((i, int(bad)))
    return rows, labels


def test_risk_and_its_gradient():
    rng = np.random.default_rng(3)
    size = rng.integers(0, 6, 40)
    flat = rng.integers(0, 5, size.sum())
    p, u = rng.random(40), rng.random(40)
    p, u = p / p.sum(), u / u.sum()
    w, bias, eps = rng.normal(size=5), -0.4, 1e-6

    def plain(w, bias):
        r_p = r_u = 0.0
        for i in range(40):
            z = sum(w[j] for j in flat[size[:i].sum() : size[: i + 1].sum()]) + bias
            r_p, r_u = r_p + p[i] / (1 + np.exp(-z)), r_u + u[i] / (1 + np.exp(-z))
        return np.array([r_p, r_u])

    got = toxicity.risk_parts(flat, size, p, u, w, bias)
    assert np.allclose(got[:2], plain(w, bias))
    for j in range(6):
        step = np.eye(6)[j] * eps
        slope = (plain(w + step[:5], bias + step[5]) - plain(w - step[:5], bias - step[5])) / (2 * eps)
        assert np.allclose([got[2 + j], got[8 + j]], slope, atol=1e-6)


def test_steps_turn_where_the_negative_risk_is_below_zero():
    """Positives that explain more than all of U would give: the step raises U's risk instead of lowering it."""
    over = lambda w, b: np.array([0.9, 0.01, 0.2, 0.2, 0.05, 0.05])
    under = lambda w, b: np.array([0.1, 0.5, 0.2, 0.2, 0.5, 0.5])
    start = np.array([1.0])
    assert toxicity.descend(over, start, 0.5)[1] < toxicity.BIAS  # gradient prior * P - U
    assert toxicity.descend(under, start, 0.1)[1] < toxicity.BIAS  # gradient U - 2 * prior * P
    assert toxicity.descend(lambda w, b: np.array([0.0, 0.01, 0.2, 0.2, 0.01, 0.01]), start, 0.5)[1] > toxicity.BIAS


def test_spark_against_one_machine(spark, corpus):
    rows, labels = corpus
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, tox int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, marks).collect()}
    learned = {k: t for k, t in labels if not held(k)}
    prior = min(max(sum(learned.values()) / len(learned), toxicity.PRIORS[0]), toxicity.PRIORS[1])
    model = toxicity.fit([(t, learned.get(k) == 1) for k, t, _ in rows if not held(k)], prior)
    used = toxicity._Used(model.slots)
    assert len(model.slots)
    for k, text, _ in rows:
        z = model.weights[used(text)].sum() + model.bias
        assert abs(got[k].score - 1 / (1 + np.exp(-z))) < 1e-6 and got[k].predicted == (got[k].score >= 0.5) and got[k].held_out == held(k)
    for lang in (0, 1):
        own = [(got[k].predicted, bad) for k, _, bad in rows if held(k) and (k % 3 == 0) == lang]
        assert sum(p for p, bad in own if bad) >= 0.95 * sum(bad for _, bad in own)
        assert sum(p for p, bad in own if not bad) <= 0.02 * len(own)
    left = {r.doc_id for r in toxicity.without_toxic(docs, marks).collect()}
    assert left == {k for k in got if not got[k].predicted}


def test_held_out_labels_of_a_table(spark):
    """Accuracy on labels that were not learned from, as the query gives it."""
    sf = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxic_scores(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert rows and sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert not any(r.predicted for r in rows if r.toxic == 0)


def test_odd_rows(spark, corpus, odd, empty):
    marks = spark.createDataFrame(corpus[1] + [(None, 1), (5, None)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for df, n in ((odd, odd.count()), (empty, 0)):
        rest = toxicity.toxic_scores(df, marks).collect()
        assert len(rest) == n and all(0 <= r.score <= 1 for r in rest)
        assert len({(r.score, r.predicted) for r in rest if r.doc_id in (2, 6)}) <= 1
        plain = toxicity.toxic_scores(df, none).collect()
        assert len(plain) == n and all(r.predicted == 0 for r in plain)
        assert sorted(map(str, toxicity.without_toxic(df, none).collect())) == sorted(map(str, df.collect()))
    assert toxicity.without_toxic(odd, marks).columns == odd.columns
