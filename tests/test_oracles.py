"""Each query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from fieldtrace.plans import catalogue


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 4) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1, abs(u)) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
