import random

import numpy as np

from cultiva.llm.repetition import repeats, repetition_profile


def longest_repeats(words, least):
    found = {}
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            found[i] = best
    return found


def test_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(3)]
        codes = np.array([c for t in texts for c in t], dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
        for least in (1, 3, 6):
            starts, lengths = repeats(codes, bounds, least)
            want = {}
            for n, words in enumerate(texts):
                want |= {i + bounds[n]: k for i, k in longest_repeats(words, least).items()}
            assert dict(zip(starts.tolist(), lengths.tolist())) == want


def test_counts_and_verdicts(samples):
    clean = " ".join(f"marsh{i} #{i % 7}" for i in range(60))
    passage = " ".join(f"w{i}" for i in range(40))
    rows = {1: clean, 2: "brine lake", 3: "mud " * 80, 4: passage + "\n" + clean[:100] + "\n" + passage, 5: None}
    got = {r["bacdive_id"]: r for r in repetition_profile(samples(rows)).collect()}
    assert got[1]["n_words"] == 120 and got[1]["n_symbols"] == 60 and got[1]["kept"]
    assert got[2]["base_failed"] and not got[2]["kept"]
    assert got[3]["base_failed"] and got[3]["n_repeat_words"] == 80
    assert got[4]["n_dup_lines"] == 1 and got[4]["longest_repeat"] == 40 and not got[4]["kept"]
    assert got[5]["n_words"] == 0 and not got[5]["kept"]


def test_edge_rows(samples, edge_rows):
    out = repetition_profile(samples(edge_rows), carry=["iso_sample_text"])
    assert out.count() == len(edge_rows)
    assert {r["word_chars"] for r in out.filter("bacdive_id = 7").collect()} == {50000}
    assert repetition_profile(samples([])).count() == 0
