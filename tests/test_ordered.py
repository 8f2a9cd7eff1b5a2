import numpy as np
import pandas as pd
import pytest

from cultiva.operators import ordered as X


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, some values repeat, one group is NULL."""
    rng = np.random.default_rng(3)
    group = rng.choice(["hot", "a", "b", None], 4000, p=[0.7, 0.1, 0.1, 0.1])
    value = np.where(rng.random(4000) < 0.3, 5.0, np.round(rng.normal(size=4000), 3))
    pdf = pd.DataFrame({"g": group, "v": value, "i": np.arange(4000)})
    df = spark.createDataFrame(pdf, "g string, v double, i bigint").repartition(7)
    return pdf, df


def test_quantiles(skewed):
    pdf, df = skewed
    marks = {"p10": 0.1, "p50": 0.5, "p97": 0.97}
    got = {r["g"]: r for r in X.grouped_quantiles(df, ["g"], "v", marks).collect()}
    for name, part in pdf.groupby("g", dropna=False):
        row = got[None if pd.isna(name) else name]
        for column, q in marks.items():
            assert row[column] == pytest.approx(part["v"].quantile(q))
    whole = X.grouped_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(pdf["v"].median())


def test_known_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert X.grouped_quantiles(df, [], "v", {"p": 0.1}).first()["p"] == pytest.approx(1.3)


def test_fractional_ranks(skewed):
    pdf, df = skewed
    ranks = X.fractional_ranks(df, ["g"], "v").toPandas()
    want = pdf.assign(g=pdf["g"].fillna("-"), r=pdf.groupby("g", dropna=False)["v"].rank())
    want = want.groupby(["g", "v"])["r"].first()
    got = ranks.assign(g=ranks["g"].fillna("-")).set_index(["g", "v"])["rank"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_row_index(skewed):
    _, df = skewed
    rows = X.row_index(df, ["v", "i"], total="n").orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(4000)) and rows[0]["n"] == 4000
    assert [(r["v"], r["i"]) for r in rows] == sorted((r["v"], r["i"]) for r in rows)


def test_descending_prefix(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("b", 1, 5)], "k string, o int, n int")
    got = {(r["k"], r["o"]): r["n_before"] for r in X.prefix_sums(df, ["k"], ["o"], ["n"], descending=True).collect()}
    assert got == {("a", 3): 0, ("a", 2): 30, ("a", 1): 50, ("b", 1): 0}


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert X.grouped_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0
