"""Token counts by finite-state transducers, without making the tokens."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cultiva.llm.kernels import arrow_map, coded, cut, sums, text_blocks
from cultiva.llm.pretokens import split_texts


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class CountTransducer:
    """Deterministic transducer from the bytes of one piece to its number of tokens.

    The state after some bytes is the node of the longest suffix that begins a
    token, and for every place where a token that ends later could begin, the last
    token of the encoding up to there with its count. A transition carries the
    change of the count. Merges make it positive, zero or negative, and the sum
    over a piece is its number of tokens.

    The last token of every prefix is unique: among the tokens that end there, it
    is the one that the merge order allows behind the last token of the text before
    it. Token nodes, failure links, transitions between nodes and the verdicts on
    token pairs are compiled once per process, the last two when first needed.
    """

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        rank = {left + right: i for i, (left, right) in enumerate(merges)}
        if len(rank) != len(merges):
            raise ValueError("a token is made by two merges")
        # Numbered in merge order, single bytes first.
        made = sorted((t for t in tokens if len(t) == 1 or t in rank), key=lambda t: rank.get(t, -1))
        number = {t: i for i, t in enumerate(made)}
        self.lengths = [len(t) for t in made]
        self.halves = [
            (number[merges[rank[t]][0]], number[merges[rank[t]][1]]) if t in rank else (i, i)
            for i, t in enumerate(made)
        ]
        self.joins = {(number[a], number[b]): number[a + b] for a, b in merges}
        self._trie(made)
        self.allowed: dict[tuple[int, int], bool] = {}
        self.moves: dict[int, int] = {}

    def _trie(self, tokens: list[bytes]) -> None:
        """Suffix automaton links over the token trie (Aho and Corasick)."""
        nexts: list[dict[int, int]] = [{}]
        token = [-1]
        depth = [0]
        for i, t in enumerate(tokens):
            node = 0
            for byte in t:
                if byte not in nexts[node]:
                    nexts[node][byte] = len(nexts)
                    nexts.append({})
                    token.append(-1)
                    depth.append(depth[node] + 1)
                node = nexts[node][byte]
            token[node] = i
        fail = [0] * len(nexts)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(nexts)
        queue = deque(nexts[0].values())
        for node in queue:
            ends[node] = ((1, token[node]),)
        while queue:
            node = queue.popleft()
            for byte, child in nexts[node].items():
                f = fail[node]
                while f and byte not in nexts[f]:
                    f = fail[f]
                fail[child] = nexts[f].get(byte, 0)
                own = ((depth[child], token[child]),) if token[child] >= 0 else ()
                ends[child] = own + ends[fail[child]]
                queue.append(child)
        self.nexts, self.fail, self.depth, self.ends = nexts, fail, depth, ends

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Undoes the merges around the seam, latest first: the pair stands unless a
        merge across the seam would have come before one of those undone.
        """
        pair = (left, right)
        known = self.allowed.get(pair)
        if known is not None:
            return known
        bound = len(self.lengths)
        verdict = None
        while verdict is None:
            across = self.joins.get((left, right))
            if across is not None and across < bound:
                verdict = False
            elif left > right and self.lengths[left] > 1:
                bound, left = left, self.halves[left][1]
            elif self.lengths[right] > 1:
                bound, right = right + 1, self.halves[right][0]
            elif self.lengths[left] > 1:
                bound, left = left, self.halves[left][1]
            else:
                verdict = True
        if len(self.allowed) > 1 << 19:
            self.allowed.clear()
        self.allowed[pair] = verdict
        return verdict

    def move(self, node: int, byte: int) -> int:
        """Node of the longest suffix that begins a token, after one more byte."""
        to = node
        while to and byte not in self.nexts[to]:
            to = self.fail[to]
        to = self.moves[node << 8 | byte] = self.nexts[to].get(byte, 0)
        return to

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Number of tokens of each piece; ``pieces`` must be sorted.

        Sorted pieces walk their prefix tree: a state is entered once however many
        pieces pass it, and its transition adds the change of the count.
        """
        moves, ends, allowed, fits = self.moves, self.ends, self.allowed, self.fits
        nodes, lasts, counts = [0], [-1], [0]
        before, result = b"", []
        for piece in pieces:
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del nodes[shared + 1 :], lasts[shared + 1 :], counts[shared + 1 :]
            node = nodes[-1]
            for byte in piece[shared:]:
                to = moves.get(node << 8 | byte)
                node = self.move(node, byte) if to is None else to
                for length, token in ends[node]:
                    last = lasts[-length]
                    if last < 0:
                        break
                    fit = allowed.get((last, token))
                    if fit or fit is None and fits(last, token):
                        break
                nodes.append(node)
                lasts.append(token)
                counts.append(counts[-length] + 1)
            result.append(counts[-1])
            before = piece
        return result


BLOCK_BYTES = 4 << 20
REMEMBERED_PIECES = 200_000
_COMPILED: dict[str, tuple[CountTransducer, re.Pattern | None]] = {}


def compiled(text: str) -> tuple[CountTransducer, re.Pattern | None]:
    """The transducer of a byte-level BPE file's content, and its special strings."""
    key = str(hash(text))
    if key not in _COMPILED:
        model = json.loads(text)
        signs = byte_signs()

        def raw(token: str) -> bytes:
            return bytes(signs[c] for c in token)

        special = [t["content"] for t in model["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        tokens = [raw(t) for t in model["model"]["vocab"] if t not in special]
        pattern = b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))
        _COMPILED.clear()
        _COMPILED[key] = (
            CountTransducer(tokens, [(raw(a), raw(b)) for a, b in merges]),
            re.compile(pattern) if special else None,
        )
    return _COMPILED[key]


def _counts(batches: Iterator[pa.RecordBatch], text: str, model, max_tokens: int) -> Iterator[pa.RecordBatch]:
    transducer, special = compiled(model.value)
    known: dict[bytes, int] = {}
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        # Special strings stand inside a text; one across two texts is none.
        stops = []
        if special is not None:
            raw = data.tobytes()
            for i in np.unique(np.searchsorted(bounds, [m.start() for m in special.finditer(raw)], "right") - 1):
                base = int(bounds[i])
                stops += [(base + m.start(), base + m.end()) for m in special.finditer(raw[base : bounds[i + 1]])]
        starts, ends, piece_bounds = split_texts(data, bounds, stops)
        codes, pieces = coded(cut(data, starts, ends))
        if len(known) > REMEMBERED_PIECES:
            known.clear()
        found = pieces.to_pylist()
        new = sorted(p for p in found if p not in known)
        known.update(zip(new, transducer.counts(new)))
        each = np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))
        n_tokens = sums(each[codes], piece_bounds)
        if stops:
            found = np.searchsorted(bounds, [s for s, _ in stops], "right") - 1
            n_tokens = n_tokens + np.bincount(found, minlength=len(n_tokens))
        out = rows.drop_columns([text])
        out = out.append_column("n_bytes", pa.array(np.diff(bounds), pa.int64()))
        out = out.append_column("n_tokens", pa.array(n_tokens, pa.int64()))
        out = out.append_column("over_limit", pa.array(n_tokens > max_tokens, pa.bool_()))
        yield from out.combine_chunks().to_batches()


def token_counts(
    samples: DataFrame,
    tokenizer: str,
    max_tokens: int = 1024,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every isolation text.

    ``tokenizer`` is the path of a byte-level BPE file (``.json``) that the driver
    can read; its content (at most a few megabytes) is broadcast. Counts equal
    those of the library that reads such files: special strings inside a text count
    as one token each, nothing is added, cut or padded.

    Two transducers run over a block of texts. The first splits texts into pieces;
    chunks of signs become maps from state to state, composed by a parallel prefix
    scan, so a text of any length is split in whole-array steps. The second reads
    the bytes of every distinct piece of the block and adds up the counts on its
    transitions. A null text counts as an empty one: 0 bytes, 0 tokens. Repeated
    rows, null keys and ties stay rows of their own; other columns are ignored.
    There is no shuffle.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    compiled(content)  # refuse a file that is no byte-level BPE before the job runs
    model = samples.sparkSession.sparkContext.broadcast(content)
    chosen = samples.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return arrow_map(
        chosen,
        partial(_counts, text=text, model=model, max_tokens=max_tokens),
        f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
