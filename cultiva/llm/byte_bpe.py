"""Byte-level encoding by replaying merges over an inverted index, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cultiva.llm.kernels import (
    arrow_map, binary_column, coded, cut, gather_ranges, sums, text_blocks,
)
from cultiva.llm.pretokens import split_texts

BLOCK_BYTES = 4 << 20
REMEMBERED_PIECES = 150_000


class MergeTable:
    """Token bytes by id, and the id that each pair of neighbouring ids merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.width = len(self.tokens)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the bounds of the pieces.

        All pieces lie in one linked row of symbols. An inverted index holds, for
        every pair that occurs, the places of its left symbols. Pairs are taken in
        rank order and merged at all their places from left to right; only the two
        pairs around a merged symbol are looked up anew and put into the index. A
        place whose pair has changed meanwhile is skipped. When a merge makes a pair
        of lower rank than the present one, the rest of the present places waits,
        as the lower rank comes first in that piece.
        """
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        first = np.array(self.single, dtype=np.int64)[raw]
        # Initial pairs: at most 65,536 kinds, so each kind is looked up once.
        joined = np.concatenate([first[:-1] * self.width + first[1:], [-1]]) if n else first
        joined[bounds[1:][bounds[1:] > 0] - 1] = -1
        kinds, inverse = np.unique(joined, return_inverse=True)
        ranks = np.array([self.pairs.get(int(k), -1) for k in kinds], dtype=np.int64)
        rank_at = ranks[inverse] if n else np.zeros(0, dtype=np.int64)
        places = np.flatnonzero(rank_at >= 0)
        order = places[np.argsort(rank_at[places], kind="stable")]
        found, starts = np.unique(rank_at[order], return_index=True)
        stops = np.append(starts[1:], len(order))
        index: dict[int, list[int]] = {
            int(r): order[a:b].tolist() for r, a, b in zip(found, starts, stops)
        }
        after = np.arange(1, n + 1)
        after[bounds[1:][bounds[1:] > 0] - 1] = -1
        ahead = np.arange(-1, n - 1)
        ahead[bounds[:-1][lengths > 0]] = -1
        self._merge(first_list := first.tolist(), rank_list := rank_at.tolist(), after.tolist(), ahead.tolist(), index)
        ids = np.array(first_list, dtype=np.int64)
        del rank_list
        live = ids >= 0
        count = np.concatenate([[0], np.cumsum(live)])
        return ids[live].astype(np.uint32), count[bounds]

    def _merge(self, symbol, rank_at, after, ahead, index) -> None:
        """Merge until no pair is left; a symbol swallowed by its neighbour is -1."""
        pairs, width = self.pairs, self.width
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for i, left in enumerate(places):
                if rank_at[left] != rank or symbol[left] < 0:
                    continue
                right = after[left]
                symbol[left] = rank
                symbol[right] = -1
                rank_at[right] = -1
                follow = after[left] = after[right]
                lowest = rank
                if follow >= 0:
                    ahead[follow] = left
                    made = pairs.get(rank * width + symbol[follow], -1)
                    rank_at[left] = made
                    if made >= 0:
                        if made in index:
                            index[made].append(left)
                        else:
                            index[made] = [left]
                            heapq.heappush(heap, made)
                        if made < lowest:
                            lowest = made
                else:
                    rank_at[left] = -1
                prior = ahead[left]
                if prior >= 0:
                    made = pairs.get(symbol[prior] * width + rank, -1)
                    rank_at[prior] = made
                    if made >= 0:
                        if made in index:
                            index[made].append(prior)
                        else:
                            index[made] = [prior]
                            heapq.heappush(heap, made)
                        if made < lowest:
                            lowest = made
                if lowest < rank:
                    rest = places[i + 1 :]
                    if rest:
                        index.setdefault(rank, []).extend(rest)
                        heapq.heappush(heap, rank)
                    break

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the byte length of every id."""
        ids = ids.astype(np.int64)
        lengths = self.bounds[ids + 1] - self.bounds[ids]
        return self.flat[gather_ranges(self.bounds[ids], lengths)], lengths


_TABLES: dict[str, MergeTable] = {}


def merge_table(content: str) -> MergeTable:
    key = str(hash(content))
    if key not in _TABLES:
        ranks = {}
        for line in content.split("\n"):
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        _TABLES.clear()
        _TABLES[key] = MergeTable(ranks)
    return _TABLES[key]


class _Memory:
    """Encodings of pieces seen lately: ids in a row, with their bounds."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.known: dict[bytes, bytes] = {}

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED_PIECES:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        ids, bounds = self.table.replay(new)
        raw, cuts = ids.tobytes(), (bounds * 4).tolist()
        self.known.update((p, raw[a:b]) for p, a, b in zip(new, cuts, cuts[1:]))
        encoded = [self.known[p] for p in pieces]
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
        return np.frombuffer(b"".join(encoded), dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _encode(batches: Iterator[pa.RecordBatch], text: str, model) -> Iterator[pa.RecordBatch]:
    memory = _Memory(merge_table(model.value))
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        starts, ends, piece_bounds = split_texts(data, bounds)
        codes, pieces = coded(cut(data, starts, ends))
        ids, id_bounds = memory.encode(pieces.to_pylist())
        lengths = np.diff(id_bounds)[codes]
        of_text = ids[gather_ranges(id_bounds[:-1][codes], lengths)]
        n_tokens = sums(lengths, piece_bounds)
        edges = np.concatenate([[0], np.cumsum(n_tokens)])
        out = rows.drop_columns([text])
        out = out.append_column("n_tokens", pa.array(n_tokens, pa.int64()))
        out = out.append_column("ids", binary_column(of_text.astype("<u4").view(np.uint8), edges * 4))
        yield from out.combine_chunks().to_batches()


def _decode(batches: Iterator[pa.RecordBatch], ids: str, into: str, model) -> Iterator[pa.RecordBatch]:
    table = merge_table(model.value)
    for rows, data, bounds in text_blocks(batches, ids, BLOCK_BYTES):
        numbers = np.frombuffer(data.tobytes(), dtype="<u4")
        raw, lengths = table.decode(numbers)
        places = np.concatenate([[0], np.cumsum(lengths)])[bounds // 4]
        yield from rows.append_column(into, binary_column(raw, places)).combine_chunks().to_batches()


def _broadcast(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="ascii") as file:
        content = file.read()
    merge_table(content)  # refuse a file without ranks before the job runs
    return df.sparkSession.sparkContext.broadcast(content)


def bpe_encode(
    samples: DataFrame, tokenizer: str, key: str = "bacdive_id", text: str = "iso_sample_text"
) -> DataFrame:
    """``(key, n_tokens, ids)``: ids of every isolation text.

    ``tokenizer`` is the path of a rank file (``.tiktoken``) on the driver; its
    content, a megabyte or so, is broadcast. ``ids`` is binary, little-endian
    unsigned 32-bit numbers. Texts are split by the byte-level pattern and every
    piece is encoded by merging pairs in rank order, without special tokens.

    The merges run once over the distinct pieces of a block of texts together: an
    inverted index from pairs to places, taken in rank order, with only the touched
    neighbours looked up again. The text of a corpus is far too large for one index,
    and pieces are independent, so blocks of a few megabytes give the same ids. A
    null text counts as an empty one and has no ids; repeated rows and null keys
    stay rows of their own; other columns are ignored. There is no shuffle.
    """
    model = _broadcast(samples, tokenizer)
    chosen = samples.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return arrow_map(
        chosen, partial(_encode, text=text, model=model), f"`{key}` {kind}, n_tokens bigint, ids binary"
    )


def bpe_decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that ``ids`` stand for as binary column ``into``.

    Null ids decode to no bytes. All other columns are kept.
    """
    model = _broadcast(encoded, tokenizer)
    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in encoded.schema)
    return arrow_map(encoded, partial(_decode, ids=ids, into=into, model=model), f"{fields}, `{into}` binary")
