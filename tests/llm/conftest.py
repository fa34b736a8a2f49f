from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that every operator on documents has to take: nulls, empty, blank, repeated and long
#: texts, texts without a letter, and columns whose names the operators use themselves.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "s", 1, "x", True),
    (2, None, "en", None, None, None, None),
    (3, "", None, "s", 0, "y", False),
    (4, " \t\n\r ", "en", "s", 4, "y", False),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "s", 1, "x", True),
    (5, "the quick brown fox jumps over the lazy dog " * 3, "en", "s", 1, "x", True),
    (None, "no id here, mail me at a.b@c.de", "de", "s", 1, "z", None),
    (6, "12345 !!! 67890", "en", "s", 1, "z", None),
    (7, "über straße 漢字 😀 é " * 4000, "de", "s", 1, "z", None),
    (8, "x" * 60_000, "en", "s", 1, "z", None),
]
ODD_SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, kept boolean"
)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
