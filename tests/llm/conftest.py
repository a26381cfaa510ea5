import duckdb
import pytest

ODD_TEXTS = [
    None, "", " ", "\n", "\n\n a\t b", "a <|endoftext|> b<|endoftext|>c", "中文 x don't  y", "x" * 5000, "!!!", "½ ²",
    "tail \n", " lead", "\nA b\nc", "MIT license, Apache\x00License; CC-BY", "été Übung\nété Übung\nété Übung", "a b " * 3000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [(k, t, None if k % 3 == 0 else "en", "block" if k % 2 else None, len(t or "")) for k, t in enumerate(ODD_TEXTS)]
    rows += [(3, "\n", "en", "s", 1), (7, "x" * 5000, "fr", "s", 5), (7, "x" * 5000, "fr", "s", 5), (None, "no id here at all", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, word string, block long, at int"
    return spark.createDataFrame([(*r, "w", 1, 2) for r in rows], schema)


@pytest.fixture(scope="session")
def docs01(sf01_dir):
    """doc_id -> (text, lang) at sf0.01."""
    return {r[0]: (r[1], r[2]) for r in duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf01_dir}/documents.parquet'").fetchall()}
