"""SimHash against votes counted in Python, searches against all pairs."""

import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cultiva.llm.fingerprints import block_masks, near_fingerprints, text_fingerprints

SOIL = "soil from a salt marsh near the river mouth at low tide taken in early spring".split()


def plain_simhash(text, shingle=2):
    words = (text or "").split()
    terms = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    if words and len(words) < shingle:
        terms = [" ".join(words)]
    votes = [0] * 64
    for term in terms:
        h, weight = int(hashlib.md5(term.encode()).hexdigest()[:16], 16), min(len(term), 64)
        for i in range(64):
            votes[i] += weight if h >> i & 1 else -weight
    return sum(1 << i for i in range(64) if votes[i] > 0)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_likeness(a, b):
    return max(0.0, round(math.cos(math.pi * bin(a ^ b).count("1") / 64), 6))


def plain_edit(text, following):
    text, following = text or "", following or ""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


@pytest.mark.parametrize("shingle", [1, 2, 3])
def test_fingerprints_against_votes(samples, shingle):
    rng = random.Random(shingle)
    rows = {i: " ".join(rng.choices(SOIL, k=rng.randrange(0, 40))) for i in range(40)}
    rows |= {40: None, 41: "", 42: "é" * 90 + "\n" + "über 🌱 tide", 43: " \t\n"}
    got = {r["bacdive_id"]: r for r in text_fingerprints(samples(rows), shingle=shingle).collect()}
    assert sorted(got) == sorted(rows)
    for i, text in rows.items():
        following = rows[(i + 1) % len(rows)]
        edited = plain_edit(text, following)
        mine, other, after = (plain_simhash(t, shingle) for t in (text, edited, following))
        assert got[i]["n_chars"] == len(text or "")
        assert got[i]["edited_text_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["simhash"], got[i]["edited_simhash"]) == (signed(mine), signed(other))
        assert got[i]["next_simhash"] == signed(after)
        assert got[i]["likeness_edited"] == pytest.approx(plain_likeness(mine, other), abs=2e-6)
        assert got[i]["likeness_next"] == pytest.approx(plain_likeness(mine, after), abs=2e-6)


def test_edge_rows(samples, edge_rows):
    rows = text_fingerprints(samples(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    assert sorted((r["bacdive_id"], r["n_chars"]) for r in rows if r["bacdive_id"]) == sorted(
        (k, len(t or "")) for k, t in edge_rows if k
    )
    equal = {r["simhash"] for r in rows if r["bacdive_id"] in (None, 4, 5) and r["n_chars"] > 0}
    assert equal == {signed(plain_simhash(edge_rows[5][1]))}
    four = [r for r in rows if r["bacdive_id"] == 4]
    assert len(four) == 2 and four[0] == four[1]
    assert text_fingerprints(samples([])).count() == 0
    alone = text_fingerprints(samples({1: "brine lake"})).first()
    assert alone["likeness_next"] == 1.0
    with pytest.raises(ValueError):
        text_fingerprints(samples([]).withColumnRenamed("bacdive_id", "n_chars"), key="n_chars")


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=3), st.integers(0, 3))
def test_every_near_pair_shares_a_table(bits, radius):
    apart = sum(1 << b for b in sorted(bits)[:radius])
    assert any(apart & (m & (1 << 64) - 1) == 0 for m in block_masks(radius, 6))


def test_search_against_all_pairs(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 40])):
            flipped = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6)))
            prints += [base ^ flipped] * rng.choice([1, 1, 3])
    asked = prints[::7] + [prints[0], 0]
    frame = spark.createDataFrame([(signed(p),) for p in prints] + [(None,)], "simhash bigint")
    queries = spark.createDataFrame([(signed(p),) for p in asked] + [(None,)], "simhash bigint")
    got = {r["simhash"]: (r["n_near"], r["nearest"]) for r in near_fingerprints(queries, frame).collect()}
    want = {}
    for q in asked:
        apart = [bin(q ^ p).count("1") for p in prints]
        near = [d for d in apart if 0 < d <= 3]
        want[signed(q)] = (sum(d <= 3 for d in apart), min(near, default=None))
    assert got == want
    assert near_fingerprints(queries, frame.limit(0)).filter("n_near > 0").count() == 0


def test_a_key_of_very_many_fingerprints(spark):
    """All in one block: lists of bounded length, the same counts."""
    frame = spark.range(3000).withColumnRenamed("id", "simhash")
    queries = frame.filter("simhash % 1000 = 5")
    got = {r["simhash"]: r["n_near"] for r in near_fingerprints(queries, frame).collect()}
    assert got == {q: sum(bin(q ^ p).count("1") <= 3 for p in range(3000)) for q in (5, 1005, 2005)}
    with pytest.raises(ValueError):
        near_fingerprints(queries, frame, radius=6)
