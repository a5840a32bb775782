from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    said = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, said, "en", "a", 1), (2, said, "en", None, None), (2, said, "en", None, None), (3, None, None, "a", 1),
        (4, "", "en", "a", 0), (5, "  \n\t\n", "de", "a", 4), (None, said + " more", "en", "a", 1), (None, None, None, None, None),
        (6, LONG, "en", "a", 1), (7, LONG + " end", "fr", "a", 1), (8, "ok", "en", "a", 2), (9, "é ß 日本 😀", "de", "b", 9),
    ]
    names = ["key", "ids", "words", "group", "gone_lines", "severity", "p_toxic", "c0", "n_lines", "dropped_id", "leaked_id", "uid", "place"]
    df = spark.createDataFrame(rows, DOCS)
    for name in names:
        df = df.selectExpr("*", f"concat('x', doc_id) as `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
