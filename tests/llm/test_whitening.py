"""Whitening against numpy's eigenvalues and exact integers."""

import numpy as np
import pytest

from cultiva.llm.whitening import inertia, leading_components, whitened_embeddings

VECTORS = "genome_accession string, embedding array<float>, component string"


def symmetric(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = q @ np.diag(values) @ q.T
    return (matrix + matrix.T) / 2


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 30):
        matrix = symmetric(rng, rng.standard_normal(n))
        for shift in (-0.7, 0.0, 0.3):
            assert inertia(matrix, shift) == int((np.linalg.eigvalsh(matrix) > shift).sum())
    # No diagonal entry can be the first pivot.
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert inertia(np.zeros((4, 4)), 0.0) == 0


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 5.0, 2.0, 1.0, 0.5, 0.1],
        [4.0, 4.0, 4.0, 1.0, 1.0],
        [1.0, 1.0 - 1e-9, 1.0 - 2e-9, 0.3],
        [1e8, 1e2, 1.0, 1e-1],
        [3.0, 0.0, 0.0],
        [2.0],
        list(np.linspace(1, 2, 40)),
    ],
)
def test_components_against_eigh(values):
    rng = np.random.default_rng(2)
    matrix = symmetric(rng, values)
    found, vectors = leading_components(matrix, 16)
    want = np.sort(values)[::-1][:16]
    want = want[want > 1e-10 * want[0]]
    assert len(found) == len(want)
    assert np.allclose(found, want, rtol=1e-9, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * want[0]


def test_components_of_nothing():
    assert len(leading_components(np.zeros((3, 3)), 16)[0]) == 0
    assert len(leading_components(np.zeros((0, 0)), 16)[0]) == 0


def plain(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    return x, n, s, e[::-1], u[:, ::-1], np.trace(covariance)


def test_rows_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 20)) * np.linspace(3, 0.5, 20)).astype(np.float32).tolist()
    vectors += vectors[:150] * 2
    rows = [(f"G{i}", v, "extra") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitened_embeddings(df).collect()
    assert len(got) == 16 * len(rows)
    x, n, s, e, u, trace = plain(vectors)
    by = {(r["genome_accession"], r["component"]): r for r in got}
    for c in range(1, 17):
        want = (x - s / n) @ u[:, c - 1] / np.sqrt(e[c - 1])
        have = np.array([by[f"G{i}", c]["whitened"] for i in range(len(rows))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert abs(by["G0", c]["explained"] - e[c - 1] / trace) < 1e-9
    for i in range(len(rows)):
        exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
        assert by[f"G{i}", 1]["deviation"] == exact and by[f"G{i}", 1]["n"] == n
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("G1", None, ""), ("G2", [], ""), ("G3", [1.0, None, 2.0], ""), ("G4", [1.0, nan, 2.0], ""),
        ("G5", [inf, 0.0, 0.0], ""), ("G6", [1.0, 2.0, 3.0], ""), ("G6", [1.0, 2.0, 3.0], ""),
        (None, [2.0, 2.0, 5.0], ""), ("G7", [0.0, 0.0], ""), ("G8", [-1.0, 2.0, 4.0], ""),
    ]
    got = whitened_embeddings(spark.createDataFrame(rows, VECTORS)).collect()
    # Three distinct vectors on a plane: two components, the constant dimension adds none.
    assert sorted({(str(r["genome_accession"]), r["component"]) for r in got}) == [
        ("G6", 1), ("G6", 2), ("G8", 1), ("G8", 2), ("None", 1), ("None", 2)
    ]
    assert len(got) == 8 and {r["n"] for r in got} == {3}
    for few in ([], rows[:5], rows[5:7]):
        assert whitened_embeddings(spark.createDataFrame(few, VECTORS)).count() == 0
    with pytest.raises(ValueError):
        whitened_embeddings(spark.createDataFrame(rows, VECTORS), key="component")
