from __future__ import annotations

import pytest

from segflux.llm.ship import ship

LONG = "lorem ipsum dolor " * 60_000

# id, text: null, empty, repeated, very long, odd characters; the ids hold a null and a repeat.
EDGE_ROWS = [
    (1, None), (2, ""), (3, "Short."), (3, "Short."), (4, "Short."), (None, "no id here at all"),
    (5, LONG), (6, "\t\n  \x0b"), (7, "Ünïcödé ñandú \U0001f600 İstanbul é"), (8, "a b c"), (9, "\x00\x01 zero"),
    (10, "<|endoftext|> 12,34.5 it's we'll"),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names clash with what operators put out."""
    rows = [(i, t, None, "src", 1.5, 7) for i, t in EDGE_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, shard int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score double, shard int")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
