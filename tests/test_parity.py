"""Every registered query against its oracle SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from parity import connect, difference, oracle_rows, spark_rows

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: Queries that SQL cannot express: file sizes, tokenizers, trained models, iterated graphs.
WITHOUT_SQL = {
    "storage_report", "op4_packing", "op5_toxicity", "op6_long_matches", "op7_simhash", "op8_language",
    "op9_vectors", "op10_pii", "pipeline",
}


def test_only_named_queries_lack_sql():
    assert set(entry.queries()) - set(entry.oracle_sql()) <= WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", entry.queries())
def test_query_equals_oracle(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF_DIR))
    if name in WITHOUT_SQL:
        assert got[1]
        return
    assert difference(got, oracle_rows(con, entry.oracle_sql()[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
