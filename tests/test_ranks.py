"""Ranks, totals and rows before, in stretches, against one sorted list."""

import random

import pytest

from fieldtrace.operators import groups, ranks


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_ranked_with_ties(spark, hot):
    rng = random.Random(3)
    data = [(i, None if i % 50 == 0 else 7.0 if rng.random() < hot else round(rng.gauss(0, 20), 1)) for i in range(3000)]
    got = ranks.ranked(spark.createDataFrame(data, "k long, v double"), "v", "k").collect()
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.rank)] == want
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(3000)) and {r._n for r in got} == {3000}


def test_a_shared_value_is_split(spark):
    rows = spark.range(4000).selectExpr("id as k", "case when id % 2 = 0 then 1.0 else rand(3) end as v")
    edges = ranks.bounds(rows, "v")
    largest = rows.withColumn("s", ranks.stretch("v", edges)).groupBy("s").count().agg({"count": "max"}).first()[0]
    assert largest == 2000  # all of the shared value, and nothing else with it
    ranked = ranks.ranked(rows.filter("k % 2 = 0"), "v", "k")
    assert [r.k for r in ranked.orderBy("rank").collect()] == list(range(0, 4000, 2))


def test_totals_and_rows_before(spark):
    rng = random.Random(5)
    data = [(v, rng.randrange(5)) for v in sorted({round(rng.expovariate(1) ** 3, 4) for _ in range(2000)}, reverse=True)]
    frame = spark.createDataFrame(data, "v double, n long")
    got = {r.v: r.n for r in groups.running_totals(frame, "v", ["n"]).collect()}
    total, want = 0, {}
    for v, n in data:
        want[v] = total = total + n
    assert got == want
    before = {r.v: r.before_n for r in ranks.previous(frame, "v", ["n"]).collect()}
    assert before == {v: (data[i - 1][1] if i else None) for i, (v, _) in enumerate(data)}
    assert ranks.ranked(frame.filter("false"), "v", "n").count() == 0 and ranks.previous(frame.filter("false"), "v", ["n"]).count() == 0
