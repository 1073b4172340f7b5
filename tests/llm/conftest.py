from __future__ import annotations

import os

import pandas as pd
import pytest

from civicspan.llm.common import let_workers_import

SMALL = os.environ.get("TEST_SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True)
def workers(spark):
    let_workers_import(spark)


@pytest.fixture(scope="session")
def small():
    """The folder of the smallest tables."""
    if not os.path.isdir(SMALL):
        pytest.skip(f"no test data in {SMALL}")
    return SMALL


@pytest.fixture(scope="session")
def small_docs(small):
    return pd.read_parquet(f"{small}/documents.parquet")


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words string, label string, spans string, "
    "ids string, p_toxic string, n_entities string, rejected_by string, decoded string, unit string, class_id string"
)
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards brew a strange green potion by the river.\n"


def messy_rows():
    """Nulls, empty and very long texts, ties, repeated rows; extra columns have the names of outputs."""
    extra = ("x",) * 10
    long_text = " ".join(f"word{i} Ünïcode" for i in range(30_000))
    mail = "Write to jane.doe@example.com, call +1 (555) 010-7788 or Mr. John Smith."
    rows = [
        (1, PROSE * 2 + mail, "en", "a", 10),
        (2, PROSE * 2 + mail, "en", "a", 10),
        (2, PROSE * 2 + mail, "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (None, PROSE + "and a tail of its own", "en", "a", 5),
        (None, None, None, None, None),
        (5, " \n\t\r\x0b\x0c ", "en", "b", 7),
        (6, long_text, "de", "b", len(long_text)),
        (7, "one two", "en", "b", 7),
        (7, "\U0001f600 𝔘𝔫𝔦 <|endoftext|> é  '", "en", "b", 7),
    ]
    return [(*row, *extra) for row in rows]


@pytest.fixture
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
