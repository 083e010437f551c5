"""Each training-data query with SQL against DuckDB, on whole tables and on odd rows."""

import duckdb
import pytest

from fieldtrace.llm import queries


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, tmp_path, odd, name):
    turns = [(1, 0, "user", "Hi."), (1, None, None, None), (None, 5, "assistant", "x"), (7, 3, "tool", " \n"), (7, -2, "", "."), (2**40, 1, "user", "é!")]
    odd.filter("doc_id is null or doc_id <> 5").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, tables in ((sf_dir, ["documents", "conversations", "pages"]), (f"file://{tmp_path}", ["documents", "conversations"])):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if folder != sf_dir else ''}'".replace("file://", ""))
        if "pages" in queries.ORACLES[name] and "pages" not in tables:
            continue
        got, want = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
