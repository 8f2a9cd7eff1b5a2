import itertools
import random

import numpy as np

from cultiva.llm.line_quality import WIDTH, LineField, _loss, fit_line_field, marginals, score_lines


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 1, 5]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(bounds[-1], WIDTH))
    field = LineField(rng.normal(size=WIDTH), rng.normal(size=(2, 2)))
    good, pairs, log_z = marginals(field, x, bounds)
    for k, n in enumerate(sizes):
        if n == 0:
            continue
        score = x[bounds[k] : bounds[k + 1]] @ field.emission
        weight = {
            y: np.exp(sum(s * (v - 0.5) for s, v in zip(score, y)) + sum(field.transition[a, b] for a, b in zip(y, y[1:])))
            for y in itertools.product((0, 1), repeat=n)
        }
        total = sum(weight.values())
        assert abs(np.log(total) - log_z[k]) < 1e-9
        for i in range(n):
            assert abs(sum(w for y, w in weight.items() if y[i]) / total - good[bounds[k] + i]) < 1e-9
            if i:
                both = sum(w for y, w in weight.items() if y[i - 1] and y[i]) / total
                assert abs(both - pairs[bounds[k] + i, 1, 1]) < 1e-9


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 2, 6])
    x, state, weight = rng.normal(size=(6, WIDTH)), rng.integers(0, 2, 6), np.array([1.0, 2.0])
    at = rng.normal(size=WIDTH + 4) / 3
    _, grad = _loss(at, x, bounds, state, weight)
    for i in range(0, len(at), 5):
        step = np.zeros(len(at))
        step[i] = 1e-6
        slope = (_loss(at + step, x, bounds, state, weight)[0] - _loss(at - step, x, bounds, state, weight)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5


def corpus(n, seed):
    rng = random.Random(seed)
    words = [w + t for w in ("salt", "mud", "soil", "sea") for t in ("y", "marsh", "bed", "ing", "")]
    rows, labels = [], []
    for i in range(n):
        prose = "\n".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(rng.randint(1, 5)))
        junk = rng.choice(["\n".join("BUY!! NOW!! " * 6 for _ in range(3)), "mud mud mud mud " * 12])
        bad = i % 4 == 0
        rows.append((i, junk if bad else prose))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_texts(spark, samples, edge_rows):
    rows, labels = corpus(160, 1)
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (999, 1)], "bacdive_id bigint, quality int")
    field = fit_line_field(samples(rows), known)
    again = fit_line_field(samples(rows), known)
    assert np.allclose(field.flat(), again.flat())
    fresh, truth = corpus(60, 2)
    score = {r["bacdive_id"]: r["score"] for r in score_lines(samples(fresh), field).collect()}
    assert all((score[i] >= 0.3) == bool(y) for i, y in truth)
    edges = score_lines(samples(edge_rows), field).collect()
    assert len(edges) == len(edge_rows)
    assert {r["score"] for r in edges if r["bacdive_id"] in (1, 2, 3)} == {0.0}
    assert all(0 <= r["score"] <= 1 for r in edges)


def test_no_labels(spark, samples):
    none = spark.createDataFrame([], "bacdive_id bigint, quality int")
    field = fit_line_field(samples({1: "salt marsh"}), none)
    assert score_lines(samples({1: "salt marsh"}), field).first()["score"] == 0.5
    assert score_lines(samples([]), field).count() == 0
