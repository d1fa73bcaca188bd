"""Fixtures shared by the operators' tests."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = r"[^\x20\x09-\x0D]+"

ODD_TEXTS = [None, "", " \n\t ", "word", "a b c d e", "é ü ñ", "x " * 3000, "same text here for all of us", "same text here for all of us", "\n\n", "İstanbul TOKEN=abcdefghijklmnop"]


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns with names the operators use."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 7, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id text with words", "en", "s", 7, "x"), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


def none_of(df):
    return df.filter("false")
