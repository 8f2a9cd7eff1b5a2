"""Every query on the smallest data folder: against its oracle, or for rows."""

import os

import pytest

from suite import REGISTRY
from suite.check import compare, connect

FOLDER = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(REGISTRY)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, oracle, name):
    problem = compare(spark, oracle, FOLDER, REGISTRY[name])
    assert problem in ("", "equal but no rows")


def test_chunk_names_past_six_digits(spark, tmp_path):
    orders = spark.range(1_000_500).selectExpr("id AS o_orderkey", "id % 7919 / 4.0D AS o_totalprice")
    orders.coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "orders.parquet")
    con = connect(str(tmp_path))
    con.execute(f"CREATE TABLE want AS {REGISTRY['chunk_names'].sql}")
    REGISTRY["chunk_names"].run(spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    con.execute(f"CREATE TABLE got AS SELECT o_orderkey, chunk FROM '{tmp_path}/got/*.parquet'")
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT count(*) FROM (FROM {a} EXCEPT FROM {b})").fetchall() == [(0,)]


def test_entry_contract(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns[0] == "n_eval"
