import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang) of the smallest data folder."""
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing column names."""
    long = "Word one two. " * 3000
    rows = [
        (1, "a b c d e f g h", "en", "s", 1, "x", 0),
        (1, "a b c d e f g h", "en", "s", 1, "x", 0),
        (1, "another text of the same id", "en", "s", 1, "x", 0),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "", 1),
        (None, "no id here but words", "de", None, 4, "y", 2),
        (4, " \t\n ", "fr", "t", 4, "z", 3),
        (5, long, "en", "s", len(long), "x", 4),
        (6, "x" * 50_000, "en", "s", 50_000, "x", 5),
        (7, "été à l'œuvre 日本語 İ \u0000 end", "fr", "s", 9, "x", 6),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, length int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_docs(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame([], schema)
