import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string, size string, kind string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names operators use inside."""
    long = " ".join(f"word{i} idiot" if i % 97 == 0 else f"word{i}" for i in range(30000))
    rows = [
        (1, "", "en", "a"), (2, None, "en", None), (None, "no id here but text", None, "a"), (3, long, "en", "b"),
        (4, "same text of some words " * 30, "en", "b"), (5, "same text of some words " * 30, "en", "b"), (5, "same text of some words " * 30, "en", "b"),
        (6, "\n\n \t", None, None), (7, "ünïcode ñandú " * 40 + "x", "es", "ç"), (8, "GNU General Public License, Apache License; CC BY. MIT-License", "en", "a"),
        (9, long + " tail", "en", "b"), (-1, "a" * 5000, "en", "b"), (None, None, None, None), (5, "another text under a repeated id " * 20, "en", "c"),
    ]
    return spark.createDataFrame([(*r, 0, 7, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
