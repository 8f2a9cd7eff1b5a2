"""Packing of tokenized texts into sequences of a fixed length."""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cultiva.llm.kernels import arrow_map, binary_column, coded, cut, gather_ranges, sums, text_blocks, word_spans
from cultiva.llm.tables import written

CAPACITY = 4096
SALTS = 256
ENCODED_AT_ONCE = 20_000
BLOCK_BYTES = 8 << 20
REMEMBERED_UNITS = 400_000


class _Encoder:
    """The tokenizer of a process, with the ids of units it met first.

    The memory holds ``REMEMBERED_UNITS`` units, among them all frequent ones; later
    ones are encoded block by block.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.known: dict[bytes, bytes] = {}

    def encode(self, units: list[bytes]) -> list[bytes]:
        """Little-endian ids of distinct units."""
        found = list(map(self.known.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for lo in range(0, len(missing), ENCODED_AT_ONCE):
            some = missing[lo : lo + ENCODED_AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast([units[i].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, encoded):
                found[i] = array("I", e.ids).tobytes()
        for i in missing[: max(0, REMEMBERED_UNITS - len(self.known))]:
            self.known[units[i]] = found[i]
        return found


_ENCODERS: dict[int, _Encoder] = {}


def _encoder(content: str) -> _Encoder:
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _Encoder(content)
    return _ENCODERS[key]


_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def encoding_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, ends, unit bounds of texts)``: parts that are encoded alone.

    Words are cut where a letter or digit meets a stop sign, which is always the
    edge of a piece, and A to Z are lower-cased, as the tokenizer does first. Words
    with "<" stay as they are: they may hold special strings.
    """
    starts, ends, word_bounds = word_spans(data, bounds)
    angle = np.concatenate([[0], np.cumsum(data == ord("<"))])
    open_ = np.zeros(len(data) + 1, dtype=np.int8)
    special = angle[ends] > angle[starts]
    open_[starts[~special]] += 1
    open_[ends[~special]] -= 1
    free = np.cumsum(open_[:-1], dtype=np.int8).astype(bool)
    small = data + ((data >= 65) & (data <= 90) & free).astype(np.uint8) * np.uint8(32)
    # Latin letters of two bytes count as letters, but for the signs of times and division.
    plain, stop = _PLAIN[data], _STOP[data]
    ends_letter, lead = plain.copy(), plain.copy()
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        ends_letter[1:] |= latin
        lead[:-1] |= latin
    cuts = np.zeros(len(data), dtype=bool)
    cuts[1:] = (stop[1:] & ends_letter[:-1]) | (stop[:-1] & lead[1:])
    at = np.flatnonzero(cuts & free)
    word = np.searchsorted(starts, at, "right") - 1
    at = at[at > starts[word]] if len(at) else at
    starts = np.sort(np.concatenate([starts, at]), kind="stable")
    return small, starts, np.sort(np.concatenate([ends, at]), kind="stable"), np.searchsorted(starts, bounds)


def _pieces(
    batches: Iterator[pa.RecordBatch], text: str, key: str, model, capacity: int, end_id: int
) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(model.value)
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        small, starts, ends, word_bounds = encoding_units(data, bounds)
        codes, distinct = coded(cut(small, starts, ends))
        encoded = encoder.encode(distinct.to_pylist())
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
        first = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(encoded), dtype="<u4")
        per_word = sizes[codes]
        of_texts = ids[gather_ranges(first[codes], per_word)]
        # The closing id goes behind every text.
        n_ids = sums(per_word, word_bounds)
        of_texts = np.insert(of_texts, np.cumsum(n_ids), np.uint32(end_id))
        n_ids = n_ids + 1
        n_pieces = -(-n_ids // capacity)
        owner = np.repeat(np.arange(len(n_ids)), n_pieces)
        piece = gather_ranges(np.zeros(len(n_ids), dtype=np.int64), n_pieces)
        start = piece * capacity
        length = np.minimum(capacity, n_ids[owner] - start)
        yield pa.record_batch(
            {
                key: rows.column(key).combine_chunks().take(pa.array(owner)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids": binary_column(
                    of_texts.astype("<u4").view(np.uint8), np.concatenate([[0], np.cumsum(length)]) * 4
                ),
            }
        )


def token_pieces(
    samples: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
) -> DataFrame:
    """``(key, piece, start, length, ids)``: the ids of every isolation text in pieces.

    ``tokenizer`` is the path of a lower-casing ``tokenizers`` file on the driver whose
    splitting never joins signs across white space or letters with stop signs, so
    that every distinct unit of a block is encoded once (:func:`encoding_units`); the
    content is broadcast. ``end_id`` follows each text. Only texts
    longer than ``capacity`` are cut; ``start`` is the number of ids before the
    piece, ``ids`` is binary (little-endian unsigned 32-bit). A null or empty text
    is one piece with the closing id. Repeated rows and null keys stay rows of their
    own; other columns are ignored. There is no shuffle.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    model = samples.sparkSession.sparkContext.broadcast(content)
    chosen = samples.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return arrow_map(
        chosen,
        partial(_pieces, text=text, key=key, model=model, capacity=capacity, end_id=end_id),
        f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary",
    )


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How many pieces of which length go where: ``counts`` is ``{length: pieces}``.

    Rows ``(length, first, n, sequence, per_sequence, offset)``: pieces number
    ``first`` to ``first + n - 1`` of that length go to the sequences from
    ``sequence`` on, ``per_sequence`` side by side in each, the first at ``offset``.

    Pieces above a third of the capacity fit at most twice into a sequence: from the
    longest down, each is matched with the longest other one that still fits. Then
    the smaller pieces, longest first, go into the tightest gap that holds them.
    All pieces of a length and all sequences with the same gap are treated at once,
    so the work depends on the capacity, not on the number of pieces; the result is
    that of the piece-by-piece rule.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    placed: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, sequences)
    sizes: list[int] = []  # gaps that have sequences, ascending
    n_sequences = 0

    def give(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        rows.append((length, placed[length], n, sequence, per, offset))
        placed[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(sizes, gap)
            gaps[gap].append((sequence, n))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        if longest not in left:
            large.pop()
            continue
        n = left[longest]
        i = bisect_left(large, capacity - longest + 1) - 1
        while i >= 0 and (large[i] not in left or (large[i] == longest and n < 2)):
            if large[i] not in left:
                large.pop(i)
            i -= 1
        if i < 0:
            give(longest, n, n_sequences, 1, 0)
            leave(capacity - longest, n_sequences, n)
        elif large[i] == longest:
            n //= 2
            give(longest, 2 * n, n_sequences, 2, 0)
            leave(capacity - 2 * longest, n_sequences, n)
        else:
            other = large[i]
            n = min(n, left[other])
            give(longest, n, n_sequences, 1, 0)
            give(other, n, n_sequences, 1, longest)
            leave(capacity - longest - other, n_sequences, n)
        n_sequences += n

    for length in sorted(left, reverse=True):
        while length in left:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                # No gap: new sequences for all that is left.
                per = capacity // length
                gap, sequence, n = capacity, n_sequences, -(-left[length] // per)
                n_sequences += n
            else:
                gap = sizes[i]
                per = gap // length
                sequence, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(i)
            full = min(n, left[length] // per)
            if full:
                give(length, full * per, sequence, per, capacity - gap)
                leave(gap - per * length, sequence, full)
            used = full
            if full < n and length in left:
                # The last pieces, fewer than a sequence takes.
                rest = left[length]
                give(length, rest, sequence + full, per, capacity - gap)
                leave(gap - rest * length, sequence + full, 1)
                used += 1
            leave(gap, sequence + used, n - used)
    return rows


def _place(batches: Iterator[pa.RecordBatch], plan: list, rank: str) -> Iterator[pa.RecordBatch]:
    length, first, _, sequence, per, offset = np.array(sorted(plan), dtype=np.int64).reshape(-1, 6).T
    wide = np.int64(1) << 42
    steps = length * wide + first
    for batch in batches:
        of = batch.column("length").to_numpy(zero_copy_only=False)
        number = batch.column(rank).to_numpy(zero_copy_only=False)
        i = np.searchsorted(steps, of * wide + number, "right") - 1
        turn = number - first[i]
        out = batch.drop_columns([rank])
        out = out.append_column("sequence_id", pa.array(sequence[i] + turn // per[i], pa.int64()))
        yield out.append_column("offset", pa.array(offset[i] + turn % per[i] * of, pa.int64()))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``capacity``.

    Every sequence holds pieces side by side from 0, ``capacity`` at most; see
    :func:`packing_plan` for the rule. Only the numbers of pieces per length, at
    most ``capacity`` rows, reach the driver. Pieces are numbered within their
    length over hashed slices, so one length that a large share of the pieces have
    spreads over many tasks. All rows and other columns are kept; repeated rows get
    places of their own. A null or impossible length raises.
    """
    fixed = written(
        pieces.withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(SALTS)).cast("int"))
    )
    slices = fixed.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {row["length"]: row["n"] for row in fixed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(length is None or not 0 < length <= capacity for length in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = slices.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("length", "_salt").orderBy(*[c for c in pieces.columns if c != "length"])
    ranked = (
        fixed.withColumn("_rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "_salt"])
        .select(*pieces.columns, (F.col("_rank") + F.col("_base")).alias("_rank"))
    )
    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in pieces.schema)
    return arrow_map(
        ranked,
        partial(_place, plan=packing_plan(counts, capacity), rank="_rank"),
        f"{fields}, sequence_id bigint, offset bigint",
    )
