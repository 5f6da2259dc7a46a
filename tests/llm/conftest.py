"""Small documents with every odd case, and readers of the given tables."""

import os

import pytest
from llm_helpers import ODD, SF


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns, some named like outputs or differing in case only."""
    rows = [(i, t, "x", 1, "y", [1]) for i, t in ODD]
    schema = "doc_id bigint, text string, spans string, bucket int, Text string, ids array<int>"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def table(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, "documents")


@pytest.fixture(scope="session")
def tokens():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
