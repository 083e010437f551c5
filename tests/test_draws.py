"""Draws by the guide table equal a search in the whole distribution."""

import time

import numpy as np

from fieldtrace.operators import resampling


def slow(key, copies, boots):
    x = key.astype(np.uint64)[:, None] + np.arange(1, boots + 1, dtype=np.uint64)[None] * np.uint64(resampling.STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(resampling.FACTORS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(resampling.FACTORS[1])
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.concatenate([copies[:, None], [np.searchsorted(resampling.distribution(int(n)), v, "right") for n, v in zip(copies, u, strict=True)]], 1)


def test_draws_equal_the_search_and_are_faster():
    rng = np.random.default_rng(3)
    key, copies = rng.integers(0, 1 << 60, 700), rng.choice([1, 1, 1, 2, 5, 60, 4096], 700)
    assert (resampling.weights(key, copies, 1000) == slow(key, copies, 1000)).all()
    ones, spent = np.ones(700, np.int64), []
    for f in (resampling.weights, slow):
        f(key, ones, 1000)
        start = time.process_time()
        f(key, ones, 1000)
        spent.append(time.process_time() - start)
    assert spent[0] < 0.7 * spent[1]


def test_groups_of_few_values_are_one_piece(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("CAST(id % 3 AS INT) AS g", "CAST(id AS DOUBLE) AS v")
    whole = {r.g: tuple(r)[1:] for r in resampling.bootstrap(rows, ["g"], "v", boots=50).collect()}
    asked = []
    monkeypatch.setattr(resampling.ranks, "bounds", lambda *a: asked.append(a) or [])
    monkeypatch.setattr(resampling, "PIECE", 100)
    cut = {r.g: tuple(r)[1:] for r in resampling.bootstrap(rows, ["g"], "v", boots=50).collect()}
    assert not asked and whole.keys() == cut.keys()
    assert all(np.allclose(whole[g], cut[g], rtol=1e-12) for g in whole)
