"""Registered queries with an oracle, on the smallest folder."""

import os

import pytest

from cultiva.llm.queries import QUERIES
from suite.check import compare, connect

FOLDER = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_query_matches_oracle(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name]) == ""


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None and n != "pipeline"])
def test_query_has_a_row_for_every_document(spark, name):
    rows = QUERIES[name].run(spark, FOLDER)
    key, table = ("vec_id", "embeddings") if "vec_id" in rows.columns else ("doc_id", "documents")
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
