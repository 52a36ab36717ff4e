from __future__ import annotations

import pytest

#: Rows that every operator on documents has to take: nulls, empty and odd texts, ties, repeated rows.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (4, "one"),
    (5, "ONE"),
    (6, "É token=abcdef 1.2.3.4\nsecond line\nthird line\nfourth line"),
    (7, "é token=abcdef 1.2.3.4\nsecond line\nthird line\nfourth line"),
    (8, "12345 !!! 67890"),
    (9, "word " * 30_000),
    (10, "a\r\nb\x00c \U0001f600 <|endoftext|> ▁"),
    (None, "nobody's text"),
    (None, "nobody's text"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with further columns whose names clash with those that operators add."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "cast(null as string) AS lang", "'s' AS source", "cast(length(text) as long) AS n_chars", "1 AS score", "2 AS hex", "3 AS __key", "4 AS root", "5 AS judged", "6 AS fp", "7 AS task", "8 AS scanned", "9 AS n_removed", "10 AS `a.b`", "11 AS th")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
