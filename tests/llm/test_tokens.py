import random

import numpy as np
import pytest
import regex

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from cultiva.llm import byte_bpe, packing, pretokens, token_counts  # noqa: E402

POOL = [
    "<|endoftext|>", "<|endof", "<|STARTOFTEXT|>", "'s", "'ll", "'r", " ", "  ", "\n", "\t", "é", "É", "中文",
    "\U0001f600", "aaaa", "!!!", "the", "tion", "привет", "12.5", "don't.", "THE.", "а́", "\u0085", " ", "ﬁ",
]


def texts(n, seed):
    rng = random.Random(seed)
    made = ["", "a" * 700, " " * 50]
    for _ in range(n):
        parts = [
            rng.choice(POOL) if rng.random() < 0.5 else "".join(rng.choices("abcdetionshrl", k=rng.randrange(1, 10)))
            for _ in range(rng.randrange(20))
        ]
        made.append("".join(parts))
    return made


def split(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = pretokens.split_texts(data, np.array([0, len(data)]))
    return [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]


def test_pieces_are_those_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in texts(400, 1):
        assert split(text) == pattern.findall(text)


def test_chunk_maps_compose():
    kinds = np.random.default_rng(0).integers(0, pretokens.N_CLASSES, (9, pretokens.CHUNK)).astype(np.uint8)
    state, want = pretokens.START, []
    for row in kinds:
        want.append(state)
        for kind in row:
            state = pretokens.TARGET[state, kind]
    assert pretokens.entry_states(pretokens.state_maps(kinds)).tolist() == want


def test_counts_equal_the_library(samples, edge_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [*enumerate(texts(300, 2)), *edge_rows]
    got = token_counts.token_counts(samples(rows), path).collect()
    def n(text):
        return len(library.encode(text or "", add_special_tokens=False).ids)
    want = [(k, len((t or "").encode()), n(t), n(t) > 1024) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(samples([]), path).count() == 0


def test_encoding_equals_the_library_and_decodes_back(samples, edge_rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path) as file:
        table = byte_bpe.merge_table(file.read())
    ranks = {t: i for i, t in enumerate(table.tokens) if t}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(texts(300, 4)), *edge_rows]
    got = byte_bpe.bpe_decode(byte_bpe.bpe_encode(samples(rows), path), path).collect()
    seen = sorted((r["bacdive_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got
                  if r["bacdive_id"] is not None)
    want = sorted(
        (k, len(ids), np.array(ids, dtype="<u4").tobytes(), (t or "").encode())
        for k, t in rows if k is not None for ids in [library.encode_ordinary(t or "")]
    )
    assert seen == want and len(got) == len(rows)


def test_replay_keeps_rank_order_when_a_lower_rank_appears():
    ranks = {bytes([b]): b for b in range(256)} | {b"xab": 256, b"ab": 257, b"abab": 258}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for piece in (b"xabab", b"ababxab", b"abababab", b"xxabab"):
        ids, _ = byte_bpe.MergeTable(ranks).replay([piece])
        assert ids.tolist() == library.encode_ordinary(piece.decode())


def piecewise(lengths, capacity):
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    bins = []
    while large:
        x = large.pop(0)
        other = next((y for y in large if x + y <= capacity), 0)
        if other:
            large.remove(other)
        bins.append(x + other)
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        fits = [i for i, used in enumerate(bins) if used + x <= capacity]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += x
        else:
            bins.append(x)
    return sorted(bins)


def test_plan_equals_the_piece_by_piece_rule():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([6, 16, 40])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(50))]
        plan = packing.packing_plan({x: lengths.count(x) for x in set(lengths)}, capacity)
        used, seen = {}, set()
        for length, first, n, sequence, per, offset in plan:
            for k in range(n):
                seen.add((length, first + k))
                used.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
        assert len(seen) == len(lengths)
        for places in used.values():
            ends = [0, *[a + b for a, b in sorted(places)]]
            assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= capacity
        assert sorted(sum(b for _, b in v) for v in used.values()) == piecewise(lengths, capacity)


def test_pieces_and_places(samples, edge_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [*enumerate(texts(200, 5), 100), *edge_rows]
    pieces = packing.token_pieces(samples(rows), path, capacity=64)
    got = packing.pack(pieces, 64).collect()
    ids, used = {}, {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert len(r["ids"]) == 4 * r["length"] and r["start"] == 64 * r["piece"]
        ids.setdefault(r["bacdive_id"], []).append(bytes(r["ids"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        ends = [0, *[a + b for a, b in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 64
    for key, text in rows:
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        if [k for k, _ in rows].count(key) == 1:
            assert b"".join(ids[key]) == want
    assert packing.pack(packing.token_pieces(samples([]), path)).count() == 0
