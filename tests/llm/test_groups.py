"""Operators that compare rows with each other, against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cultiva.llm import fuzzy_lines, jaccard
from cultiva.llm import flat_graph
from cultiva.llm.flat_graph import audited_recall, embedding_duplicates
from cultiva.llm.kernels import hashed, hashed_spans, mixed
from cultiva.llm.substrings import remove_repeated_windows
from cultiva.llm.tables import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_copies(n, seed, words=60):
    """Texts of a few families whose members differ in some words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    families = [rng.choices(vocabulary, k=words) for _ in range(4)]
    rows = []
    for i in range(n):
        text = list(rng.choice(families)) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randrange(1, words))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (139, 100)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_all_pairs(samples, edge_rows, seed):
    rows = near_copies(120, seed)
    sets = {}
    for key, text in rows:
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text)]
        sets[key] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    assert len(links) > 50
    want = smallest_reachable(sets, links)
    out = jaccard.jaccard_components(samples([*rows, *[(k and k + 1000, t) for k, t in edge_rows]])).collect()
    got = {r["bacdive_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert {k: got[k] for k in sets} == {k: (len(sets[k]), want[k]) for k in sets}
    assert len(out) == len(rows) + len(edge_rows)
    assert got[1001] == (0, 1001) and got[1005] == (9, 1004) and got[1004] == (9, 1004)
    assert jaccard.jaccard_components(samples([])).count() == 0


def test_jaccard_without_pivots_finds_the_same(samples, monkeypatch):
    # The second step alone must be complete: pivots only save work.
    rows = near_copies(60, 3)
    want = {r["bacdive_id"]: r["component_id"] for r in jaccard.jaccard_components(samples(rows)).collect()}

    def none(batches, percent):
        for batch in batches:
            yield batch.select(["cls"]).rename_columns(["a"]).append_column("b", batch.column("cls")).slice(0, 0)

    monkeypatch.setattr(jaccard, "_stars", none)
    got = {r["bacdive_id"]: r["component_id"] for r in jaccard.jaccard_components(samples(rows)).collect()}
    assert got == want


def test_shingles_of_one_text_lead_the_prefix_when_buckets_are_full():
    # Counts of buckets tell nothing in a large corpus: unrelated texts with common
    # passages must still have prefixes of their own.
    passages = [" ".join(f"p{i}x{j}" for j in range(60)) for i in range(4)]
    texts = [
        " ".join([passages[i % 4], passages[(i + 1 + i // 4 % 3) % 4], *(f"u{i}x{j}" for j in range(80))])
        for i in range(60)
    ]
    parts = [jaccard._counted([pa.record_batch({"t": pa.array(some)})], "t", 4, 20) for some in (texts[::2], texts[1::2])]
    rows = pa.concat_tables(pa.Table.from_batches(list(p)) for p in parts).sort_by([("row", "ascending"), ("segment", "ascending")])
    rarity = jaccard.Rarity(20)
    for batch in jaccard._added(rows.to_batches()):
        for found in batch.to_pylist():
            if found["row"] == 0:
                rarity.seen.put(0, found["segment"], found["total"])
    rarity.counts[:] = 1000
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *map(len, texts)])
    sets = jaccard._Sets(np.frombuffer(data, dtype=np.uint8), bounds, 4, 85, rarity)
    owner = {}
    for i in range(len(texts)):
        for token in sets.h[sets.bounds[i] :][: sets.prefix[i]].tolist():
            owner.setdefault(token, set()).add(i)
    assert sets.prefix.min() > 20 and max(map(len, owner.values())) == 1
    plain = jaccard._Sets(np.frombuffer(data, dtype=np.uint8), bounds, 4, 85, None)
    assert len({t for i in range(60) for t in plain.h[plain.bounds[i] :][: plain.prefix[i]].tolist()}) < sets.prefix.sum()


class Held:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


def test_prefixes_hold_only_shingles_that_may_meet():
    # Tokens of one text alone would fill the sketch as the corpus grows.
    own = [" ".join(f"u{i}x{j}" for j in range(80)) for i in range(40)]
    copies = [own[i] + f" and one word more {i}" for i in range(4)]
    batch = pa.record_batch({"k": pa.array(range(44)), "t": pa.array(own + copies)})
    parts = [pa.Table.from_batches(list(jaccard._counted([batch], "t", 4, 20)))]
    rarity = jaccard.Rarity(20)
    for done in jaccard._added(pa.concat_tables(parts).sort_by([("row", "ascending"), ("segment", "ascending")]).to_batches()):
        for found in done.to_pylist():
            if found["row"] == 0:
                rarity.seen.put(0, found["segment"], found["total"])
    data = "".join(own + copies).encode()
    sets = jaccard._Sets(np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *map(len, own + copies)]), 4, 85, rarity)
    members = list(jaccard._members([batch], "t", 4, 85, Held(rarity), ["t"]))
    tokens = [np.frombuffer(v, dtype=np.uint64) for out in members for v in out.column("prefix").to_pylist()]
    assert sum(len(t) == 0 for t in tokens[4:40]) >= 30 and sets.prefix.min() > 10
    assert all(len(t) for t in tokens[40:]) and all(len(t) for t in tokens[:4])

    class All:
        def repeated(self, h):
            return np.ones(len(h), dtype=bool)

    for out in jaccard._bucket_rows(members, Held(All()), 85):
        places = {(c, p): t for c, t, p in zip(*(out.column(x).to_pylist() for x in ("cls", "token", "place"))) if p >= 0}
        assert len(places) == sum(map(len, tokens))
        for i in range(44):
            at = sets.bounds[i] + np.arange(sets.prefix[i])
            for p, token in enumerate(sets.h[at].view(np.int64).tolist()):
                assert places.get((int(sets.cls.view(np.int64)[i]), p), token) == token


def test_repeated_windows_against_counting(samples, edge_rows):
    rng = random.Random(4)
    passages = [[f"p{i}x{j}" for j in range(12)] for i in range(3)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(9))]
        rows.append((i, "  ".join(words)))
    rows.append((60, " ".join("mud" for _ in range(20))))
    width, seen = 6, {}
    for key, text in rows:
        words = WORD.findall(text)
        for i in range(len(words) - width + 1):
            seen.setdefault(tuple(words[i : i + width]), []).append((key, i))
    gone = {}
    for places in seen.values():
        if len(places) > 1:
            for key, i in places:
                gone.setdefault(key, set()).update(range(i, i + width))
    # A narrow sketch raises many false alarms, which must not change the result.
    for log_cells in (16, 20):
        out = remove_repeated_windows(samples(rows), width=width, log_anchor_cells=log_cells, log_window_cells=log_cells)
        got = {r["bacdive_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()}
        for key, text in rows:
            words, removed = WORD.findall(text), gone.get(key, set())
            kept = " ".join(w for i, w in enumerate(words) if i not in removed)
            assert got[key] == (len(words), len(removed), kept)
    edges = remove_repeated_windows(samples(edge_rows), log_anchor_cells=16, log_window_cells=16).collect()
    assert len(edges) == len(edge_rows)
    assert {r["n_removed"] for r in edges if r["bacdive_id"] == 6} == {18000}
    assert remove_repeated_windows(samples([]), log_anchor_cells=16, log_window_cells=16).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_against_the_table():
    rng = random.Random(5)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(14))) for _ in range(2))
        assert fuzzy_lines.edit_distance(a, b) == levenshtein(a, b)


def test_within_against_the_edit_distance():
    rng = random.Random(11)
    for _ in range(1500):
        a = "".join(rng.choices("abc", k=rng.randrange(14)))
        b = list(a) if rng.random() < 0.5 else rng.choices("abc", k=rng.randrange(14))
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcx"))
        distance = levenshtein(a, "".join(b))
        assert [fuzzy_lines.within(a, "".join(b), m) for m in range(16)] == [distance <= m for m in range(16)]


def test_hashes_of_spans_are_those_of_the_strings():
    rng = random.Random(12)
    words = [rng.randbytes(n % 20) for n in range(2000)] + [rng.randbytes(60)] * 2
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts = ends - [len(w) for w in words]
    assert (hashed_spans(data, starts, ends) == hashed(pa.array(words, pa.large_binary()))).all()
    assert len(hashed_spans(data[:0], starts[:0], ends[:0])) == 0


def test_lines_are_found_again_by_their_bytes():
    """With the length and class that the first reading gave them, and without reading the words of others."""
    text = pa.array(["Soil, from a  marsh\n\nWater 12 of the Étang\r", None, "water 12 OF the Étang\nlong " + "w " * 300])
    batch = pa.record_batch({"k": pa.array(range(3)), "_doc": pa.array(range(3)), "t": text})
    rows = pa.Table.from_batches(list(fuzzy_lines._lines([batch], "t", "k", 3, True))).to_pylist()
    first = {r["cls"]: r for r in rows if r["raw"] is not None}
    assert len(first) == 3 and len(rows) == 4

    class One:
        def repeated(self, h):
            return np.isin(h, np.array([wanted["raw"]]).view(np.uint64))

    for wanted in first.values():
        (out,) = fuzzy_lines._wanted_lines([batch], "t", Held(One()), True)
        assert out.column("cls").to_pylist() == [wanted["cls"]]
        assert len(out.column("line")[0].as_py()) == wanted["chars"]


@pytest.mark.parametrize("n", [20, 300])
def test_rows_of_lines_too_unlike_in_length_go(n):
    # All SimHashes alike.
    rng = np.random.default_rng(n)
    chars = np.exp(rng.uniform(1, n / 14, size=n)).astype(np.int64)
    batch = pa.record_batch(
        {
            "token": pa.array(np.full(n, int(fuzzy_lines._HALF))), "cls": pa.array(np.arange(n)),
            "sim": pa.array(np.zeros(n, dtype=np.int64)), "chars": pa.array(chars),
        }
    )
    got = {c for out in fuzzy_lines._near_rows([batch], 90) for c in out.column("cls").to_pylist()}
    want = {
        i for i, x in enumerate(chars.tolist())
        if any(i != j and 10 * abs(x - y) <= max(x, y) for j, y in enumerate(chars.tolist()))
    }
    assert got == want and len(want) < n


def test_block_keys_miss_no_near_hash():
    rng = random.Random(6)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), fuzzy_lines.DISTANCE):
            b ^= 1 << bit
        keys = fuzzy_lines.block_keys(np.array([a, b], dtype=np.uint64))
        assert (keys[0] == keys[1]).any()


def test_a_near_pair_is_reported_by_one_block_key():
    rng = random.Random(8)
    for _ in range(100):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(fuzzy_lines.DISTANCE + 1)):
            b ^= 1 << bit
        both = np.array([a, b], dtype=np.uint64)
        keys = fuzzy_lines.block_keys(both) & ~np.uint64(3)
        shared = keys[0][keys[0] == keys[1]]
        n = len(shared)
        own = fuzzy_lines._in_first_bucket(np.repeat(both[:1], n), np.repeat(both[1:], n), shared.view(np.int64))
        assert own.sum() == 1
        half = fuzzy_lines._in_first_bucket(both[:1], both[1:], np.array([1]))
        assert not half.any() and fuzzy_lines._in_first_bucket(both[:1], ~both[1:], np.array([1])).all()


def test_fuzzy_lines_against_all_pairs(samples, edge_rows):
    rng = random.Random(7)
    vocabulary = [f"sand{i}" for i in range(300)]
    bases = [rng.choices(vocabulary, k=50) for _ in range(5)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(bases)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randrange(12))
            if line and rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    classes = {}
    for key, text in rows:
        for n, line in enumerate(text.split("\n")):
            words = tuple(line.lower().split())
            if len(words) >= fuzzy_lines.MIN_WORDS:
                classes.setdefault(words, []).append((key, n))
    def folded(words):
        return ["".join("0" if c.isdigit() else c for c in w) for w in words]

    names = sorted(classes)
    lines = [" ".join(c) for c in names]
    data = np.frombuffer("\n".join(lines).encode(), dtype=np.uint8)
    sim = fuzzy_lines._Lines(data, np.array([0, len(data)])).simhashes(np.arange(len(names)))

    def candidates(a, b):
        x, y = sorted((folded(names[a]), folded(names[b])), key=len)
        n, more = len(x), len(y)
        if more - n <= 1 and more < fuzzy_lines.FUZZY_WORDS:
            without = [y[:i] + y[i + 1 :] for i in range(more)]
            return x == y or (x in without if n < more else any(x[:i] + x[i + 1 :] == w for i, w in enumerate(without)))
        if n < fuzzy_lines.FUZZY_WORDS:
            return False
        bits = bin(int(sim[a] ^ sim[b])).count("1")
        heads = {m for m in (n // 2, (n + 1) // 2) if m in (more // 2, (more + 1) // 2)}
        tails = {m for m in ((n + 1) // 2, (n + 2) // 2) if m in ((more + 1) // 2, (more + 2) // 2)}
        half = any(x[:m] == y[:m] for m in heads) or any(x[-m:] == y[-m:] for m in tails)
        return bits <= fuzzy_lines.DISTANCE or half and bits <= fuzzy_lines.HALF_DISTANCE

    links = [
        (a, b) for a in range(len(names)) for b in range(a + 1, len(names))
        if 10 * levenshtein(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b])) and candidates(a, b)
    ]
    assert links
    group = smallest_reachable(range(len(names)), links)
    occurrences = {}
    for i, name in enumerate(names):
        occurrences.setdefault(group[i], []).extend(classes[name])
    gone = {at for places in occurrences.values() for at in set(places) - {min(places)}}
    out = {r["bacdive_id"]: r for r in fuzzy_lines.remove_fuzzy_lines(samples(rows).drop("score", "n_words")).collect()}
    for key, text in rows:
        kept = [line for n, line in enumerate(text.split("\n")) if (key, n) not in gone]
        assert out[key]["kept_text"] == "\n".join(kept)
    edges = fuzzy_lines.remove_fuzzy_lines(samples(edge_rows)).collect()
    assert len(edges) == len(edge_rows) and {r["score"] for r in edges} == {"extra"}
    assert {r["kept_text"] for r in edges if r["bacdive_id"] == 4} != {""}
    assert {r["kept_text"] for r in edges if r["bacdive_id"] == 5} == {""}
    assert fuzzy_lines.remove_fuzzy_lines(samples([])).count() == 0


def test_a_bucket_of_near_lines_gives_fewer_links_than_rows():
    # Two hundred lines meet under one key: forty variants each of five unlike lines.
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcdefghij", k=60)) for _ in range(5)]
    lines = [stems[i % 5] + f"{i:03}" for i in range(200)]
    cls = np.arange(1000, 1200)
    token = np.full(200, int(fuzzy_lines._HALF))
    batch = pa.record_batch(
        {
            "token": pa.array(token), "cls": pa.array(cls), "sim": pa.array(np.zeros(200, dtype=np.int64)),
            "component": pa.array(cls), "line": pa.array(lines),
        }
    )
    # Far enough apart to be this bucket's pairs, near enough to be compared.
    sim = np.array([sum(1 << 9 * k + i % 7 for k in range(7)) for i in range(200)])
    batch = batch.set_column(2, "sim", pa.array(sim))
    found = [pair for out in fuzzy_lines._rest_links([batch], 90) for pair in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    near = np.bitwise_count(sim[:, None] ^ sim[None, :])
    pivot = int(cls[np.argmin(mixed(cls.view(np.uint64)))])
    true = [
        (cls[i], cls[j]) for i in range(200) for j in range(i)
        if fuzzy_lines.DISTANCE < near[i, j] <= fuzzy_lines.HALF_DISTANCE
        and pivot not in (cls[i], cls[j]) and fuzzy_lines.similar(lines[i], lines[j], 90)
    ]
    assert len(true) > 1000 and len(found) < 200
    nodes = cls.tolist()
    assert smallest_reachable(nodes, found) == smallest_reachable(nodes, true)


def test_lines_that_differ_in_digits_are_compared_with_their_digits(samples):
    bases = [
        "12 34 56", "78 90 12", "2020 01 02", "1999 12 31", "a 17 b 23 c 45 d", "a 98 b 67 c 81 d",
        "2 litres of the spring water from site number 14", "2 litres of the spring water from site number 15",
        "9 1 8 2 7 3 6 4 5 0", "1 9 2 8 3 7 4 6 5 5", "sample taken in year 2011 there", "sample taken in year 2012 there",
        "12 34 56",
    ]
    links = [
        (a, b) for a in range(len(bases)) for b in range(a)
        if 10 * levenshtein(bases[a], bases[b]) <= max(len(bases[a]), len(bases[b]))
    ]
    assert sorted(links) == [(7, 6), (11, 10), (12, 0)]
    group = smallest_reachable(range(len(bases)), links)
    rows = samples(list(enumerate(bases))).drop("score", "n_words")
    out = fuzzy_lines.remove_fuzzy_lines(rows).collect()
    kept = {r["bacdive_id"]: 1 - r["n_removed"] for r in out}
    assert kept == {i: int(group[i] == i) for i in range(len(bases))}


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16))
    base[: n // 3] = base[0] + 0.15 * rng.normal(size=(n // 3, 16))
    base[5], base[6] = base[4], 3 * base[4]
    rows = [(f"GCA_{i:05d}", [float(v) for v in x]) for i, x in enumerate(base)]
    odd = [None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(f"GCB_{i}", v) for i, v in enumerate(odd)]


def test_embedding_duplicates_against_all_pairs(spark):
    rows = vectors(300, 1)
    usable = {
        k: np.array(v) / np.linalg.norm(v) for k, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    links = [
        (a, b) for a in usable for b in usable
        if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.95
    ]
    want = smallest_reachable([k for k, _ in rows], links)
    degree = {k: sum(k in p for p in links) for k, _ in rows}
    df = spark.createDataFrame(rows, "genome_accession string, embedding array<double>")
    out = {r["genome_accession"]: r for r in embedding_duplicates(df.withColumn("cls", F.lit(1))).collect()}
    found = sum(r["n_links"] for r in out.values())
    assert found >= 0.9 * 2 * len(links) and all(out[k]["n_links"] <= degree[k] for k in out)
    assert {k: r["component_id"] for k, r in out.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in out.items())
    assert embedding_duplicates(df.limit(0)).count() == 0
    pairs = spark.createDataFrame([], "a bigint, b bigint")
    one = spark.createDataFrame([(1, np.ones(2).tobytes()), (2, np.ones(2).tobytes())], "cls bigint, vec binary")
    assert audited_recall(one, pairs) == 0.0


def test_embeddings_of_a_hot_region_with_many_centres(spark, monkeypatch):
    """More centres within the margin than shards of a vector, several blocks and parts."""
    for name, value in {"MAX_SHARDS": 2, "SHARD_VECTORS": 6, "BLOCK_VECTORS": 20, "ASK_VECTORS": 30}.items():
        monkeypatch.setattr(flat_graph, name, value)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    first = centre + 0.45 * rng.normal(size=(150, 24))
    x = np.concatenate([first, first + 0.16 * rng.normal(size=first.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    degree = near.sum(axis=1) - 1
    rows = [(f"g{i:03}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "genome_accession string, embedding array<double>")
    out = {r[0]: r[1] for r in embedding_duplicates(df).select("genome_accession", "n_links").collect()}
    share = [out[f"g{i:03}"] / d for i, d in enumerate(degree) if d]
    assert len(share) > 100 and max(share) <= 1 and np.mean(share) >= 0.97


def test_closest_are_those_of_a_full_sort():
    rng = np.random.default_rng(9)
    similar = rng.normal(size=(40, 3000)).astype(np.float32)
    similar[5] = 1.0  # all alike
    similar[6, :100] = 2.0
    for c in (1, 20, 48, 200):
        top = flat_graph.closest(similar, c)
        assert top.shape == (40, c) and all(len(set(t)) == c for t in top.tolist())
        found = np.sort(np.take_along_axis(similar, top, axis=1), axis=1)
        assert (found == np.sort(similar, axis=1)[:, -c:]).all()


def test_a_shard_of_usual_density_is_one_block():
    # Of two blocks every member and visitor would walk both.
    assert flat_graph.BLOCK_VECTORS >= flat_graph.MAX_SHARDS * flat_graph.SHARD_VECTORS


def test_walk_decides_in_double_precision():
    # Cosines closer to the threshold than single precision can tell.
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 300, 2):
        away = x[i + 1] - (x[i + 1] @ x[i]) * x[i]
        cosine = 0.95 + rng.choice([-1, 1]) * 1e-9
        x[i + 1] = cosine * x[i] + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
    a, b = flat_graph.build_graph(x)
    edges = np.searchsorted(a, np.arange(301))
    q, found = flat_graph.search(x, edges, b, x, np.arange(300), 0.95)
    got = {(i, j) for i, j in zip(q.tolist(), found.tolist()) if i != j}
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i != j}
    assert 0 < len(true) < 300 and got <= true and len(got) >= 0.97 * len(true)
    assert len(q) == len(got) + len({(i, j) for i, j in zip(q.tolist(), found.tolist()) if i == j})


def test_audit_counts_every_class_once(spark):
    """One lost pair of a small group weighs as much as a large group found whole."""
    x = np.eye(4)
    rows = [(i, x[0].tobytes()) for i in range(8)] + [(i, x[1].tobytes()) for i in (8, 9)]
    pairs = [(a, b) for a in range(8) for b in range(a + 1, 8)]
    recall = audited_recall(
        spark.createDataFrame(rows, "cls bigint, vec binary"), spark.createDataFrame(pairs, "a bigint, b bigint")
    )
    assert recall == pytest.approx(0.8)


def test_low_recall_widens_before_it_raises(spark, monkeypatch):
    margins = []

    def linked(classes, n, threshold, margin, beam):
        margins.append(round(margin, 4))
        return classes.selectExpr("cls as a", "cls as b").limit(0)

    monkeypatch.setattr(flat_graph, "_linked", linked)
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01])], "genome_accession string, embedding array<double>")
    with pytest.raises(RuntimeError, match="widest margin"):
        embedding_duplicates(df)
    assert margins == [0.17, 0.34, 0.6325]


@pytest.mark.parametrize("n", [3, 5, 8, 20, 50])
def test_recall_of_lines_with_one_other_word(samples, n):
    """Held against edit similarity alone: whatever finds the candidates is not used."""
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß", k=rng.randrange(3, 12))) for _ in range(5000)]
    rows, similar = [], []
    for i in range(200):
        line = rng.choices(vocabulary, k=n)
        at, other = rng.randrange(n), list(line)
        word = other[at]
        change = rng.randrange(3)
        if n > 7 and change == 0:
            other[at] = rng.choice(vocabulary)
        elif n > 8 and change == 1:
            del other[at]
        else:
            other[at] = word[:-1] + rng.choice("xyz0ß")
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
        a, b = " ".join(line), " ".join(other)
        similar.append(a != b and 10 * levenshtein(a, b) <= max(len(a), len(b)))
    got = fuzzy_lines.remove_fuzzy_lines(samples(rows).drop("score", "n_words")).collect()
    removed = {r["bacdive_id"]: r["n_removed"] for r in got}
    assert sum(similar) > 80
    assert sum(removed[2 * i + 1] for i in range(200) if similar[i]) >= 0.9 * sum(similar)
    assert not any(removed[2 * i] for i in range(200))
    assert not any(removed[2 * i + 1] for i in range(200) if not similar[i] and rows[2 * i][1] != rows[2 * i + 1][1])
