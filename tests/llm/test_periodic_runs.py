"""Periodic runs against a search over all periods and places."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cultiva.llm.periodic_runs import periodic_runs, periodic_stretches


def plain_runs(words, min_length, min_exponent):
    """All maximal stretches of every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, min_exponent * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_collapse(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def caught(texts, min_length, min_exponent):
    codes = np.array([c for t in texts for c in t], dtype=np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out = [[] for _ in texts]
    for t, s, e, p in periodic_stretches(codes, bounds, min_length, min_exponent):
        out[t].append((int(s), int(e - s), int(p)))
    return out


def periodic(rng, size, letters):
    """Words with repeated stretches of stretches."""
    words = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
    while len(words) < size:
        kind = rng.random()
        if kind < 0.5:
            a = rng.randrange(len(words))
            words += words[a:] * rng.randrange(1, 6)
        else:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
    return words[:size]


@pytest.mark.parametrize("least", [(1, 2), (6, 2), (1, 3), (24, 3), (10, 4)])
def test_runs_against_all_periods(least):
    rng = random.Random(11)
    for _ in range(120):
        texts = [periodic(rng, rng.randrange(0, 140), rng.choice([1, 2, 3, 30])) for _ in range(3)]
        assert caught(texts, *least) == [plain_runs(t, *least) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=70), min_size=1, max_size=3))
def test_two_words_only(texts):
    assert caught(texts, 3, 2) == [plain_runs(t, 3, 2) for t in texts]


def test_words_with_equal_polynomials():
    """Sequences on which polynomial hashes modulo a power of two agree by chance."""
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    other = [1 - c for c in thue]
    texts = [thue + other + thue + other + thue, (thue[:1024] + other[:1024]) * 3]
    assert caught(texts, 24, 3) == [plain_runs(t, 24, 3) for t in texts]


def test_long_text_of_one_word():
    (runs,) = caught([[7] * 300_000], 24, 3)
    assert runs == [(0, 300_000, 1)]


def test_operator_rows(samples):
    rng = random.Random(5)
    rows = {}
    for i in range(60):
        words = [f"soil{c}" for c in periodic(rng, rng.randrange(0, 200), rng.choice([2, 4, 40]))]
        rows[i] = (" \n" if i % 2 else "\t").join(words) + ("\n" if i % 3 else "")
    got = {r["bacdive_id"]: r for r in periodic_runs(samples(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows.items():
        words = text.split()
        runs = plain_runs(words, 24, 3)
        assert [tuple(r) for r in got[i]["runs"]] == runs and got[i]["n_words"] == len(words)
        assert got[i]["collapsed_text"] == plain_collapse(words, runs)


def test_edge_rows(samples, edge_rows):
    out = periodic_runs(samples(edge_rows), carry=["score"])
    rows = out.collect()
    assert len(rows) == len(edge_rows) and {r["score"] for r in rows} == {"extra"}
    by_key = {r["bacdive_id"]: r for r in rows}
    assert by_key[1]["runs"] == [] and by_key[1]["collapsed_text"] == "" and by_key[3]["n_words"] == 0
    assert [tuple(r) for r in by_key[6]["runs"]] == [(0, 18000, 2)]
    assert by_key[6]["collapsed_text"] == "hot spring"
    assert periodic_runs(samples([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(samples([]), carry=["n_words"])
    with pytest.raises(ValueError):
        periodic_runs(samples([]), min_exponent=1)
