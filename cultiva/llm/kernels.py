"""Array helpers for blocks of texts inside a task.

A block is a slice of an Arrow batch with a few megabytes of UTF-8 text. Words,
lines and their dictionaries are found with numpy and Arrow on the raw bytes,
never with a loop over characters.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

TEXT_BLOCK_BYTES = 8 << 20
RECORDS_PER_BATCH = 512

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
NEWLINE = 10


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for whole long texts.

    Workers get this package's folder on their path, wherever the driver was started.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS_PER_BATCH))
    return df.mapInArrow(partial(_released, function=function), schema)


def _released(batches: Iterator[pa.RecordBatch], function: Callable) -> Iterator[pa.RecordBatch]:
    """``function``, after which the worker gives back what it no longer needs.

    Workers live on for later tasks; freed blocks they keep would add up over the
    stages of a long job.
    """
    yield from function(batches)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def carried(df: DataFrame, key: str, text: str, carry) -> tuple[DataFrame, str, list[str]]:
    """``(rows, fields, drop)`` for a map that keeps ``key`` and the columns ``carry``.

    ``fields`` is the schema text of what the map passes through, ``drop`` lists what
    it must leave out of its result.
    """
    names = list(dict.fromkeys([key, text, *carry]))
    chosen = df.select(*[f"`{n}`" for n in names])
    kept = [n for n in names if n == key or n in carry]
    fields = ", ".join(f"`{n}` {chosen.schema[n].dataType.simpleString()}" for n in kept)
    return chosen, fields, [n for n in names if n not in kept]


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str, size: int = TEXT_BLOCK_BYTES
) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """``(rows, bytes, bounds)`` blocks of about ``size`` bytes of text.

    ``bounds`` has one entry more than rows: text ``i`` is
    ``bytes[bounds[i]:bounds[i + 1]]``. A null text is an empty one. A text longer
    than ``size`` is a block of its own; texts are never cut.
    """
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += batch.column(column).nbytes
        if held >= size:
            yield from _slices(waiting, column, size)
            waiting, held = [], 0
    if waiting:
        yield from _slices(waiting, column, size)


def _slices(batches: list[pa.RecordBatch], column: str, size: int):
    table = pa.Table.from_batches(batches)
    texts = pc.fill_null(table.column(column).cast(pa.large_binary()), b"")
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]).astype(np.int64)
    start = 0
    while start < len(table):
        end = int(np.searchsorted(bounds, bounds[start] + size, "right")) - 1
        end = min(max(end, start + 1), len(table))
        yield table.slice(start, end - start), flat(texts.slice(start, end - start)), (
            bounds[start : end + 1] - bounds[start]
        )
        start = end


def flat(values) -> np.ndarray:
    """All bytes of a binary column in a row."""
    parts = []
    for chunk in values.chunks if isinstance(values, pa.ChunkedArray) else [values]:
        wide = chunk.cast(pa.large_binary())
        if len(wide) == 0 or wide.buffers()[2] is None:
            continue
        offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
        parts.append(np.frombuffer(wide.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values cut out of a flat byte array at ``bounds``."""
    offsets = np.ascontiguousarray(bounds, dtype=np.int64)
    data = np.ascontiguousarray(values)
    wide = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return wide.cast(pa.binary())


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word bounds of every text."""
    inside = ~IS_SPACE[data]
    return _runs(inside, bounds)


def _runs(inside: np.ndarray, bounds: np.ndarray):
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all lines (split at line feeds), empty ones included.

    Every text has one line at least; the third array has the line bounds of texts.
    """
    breaks = np.flatnonzero(data == NEWLINE)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    per_text = np.searchsorted(breaks, bounds[1:]) - np.searchsorted(breaks, bounds[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_text)])


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings ``data[starts[i]:ends[i]]``; spans ascend and do not overlap."""
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    some = ends > starts
    mark[starts[some]] += 1
    mark[ends[some]] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = data[inside]
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    )


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of byte strings, and the distinct strings."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def hashed(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.to_pylist()), dtype=np.uint64, count=len(values))


# Of XXH3 for up to 16 bytes: what its secret and a seed of 0 come to, and its multipliers.
_FLIP_3, _FLIP_8, _FLIP_LOW, _FLIP_HIGH = (
    np.uint64(v) for v in (0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A)
)
_P2, _P3, _MX1, _MX2 = (
    np.uint64(v) for v in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x165667919E3779F9, 0x9FB21C651E98DF25)
)
SPANS_AT_ONCE = 1 << 15


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """:func:`hashed` of the byte strings ``data[starts[i]:ends[i]]``; spans ascend and do not overlap.

    The formulas of XXH3 for up to 16 bytes are evaluated side by side; longer ones are
    hashed one by one, each distinct one once.
    """
    result = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    for lo in range(0, len(starts), SPANS_AT_ONCE):
        first, n = starts[lo : lo + SPANS_AT_ONCE], lengths[lo : lo + SPANS_AT_ONCE]
        out = result[lo : lo + SPANS_AT_ONCE]
        for low, high, function in ((1, 3, _hash_3), (4, 8, _hash_8), (9, 16, _hash_16)):
            at = np.flatnonzero((n >= low) & (n <= high))
            if len(at):
                out[at] = function(eight, first[at], n[at])
    rest = np.flatnonzero((lengths > 16) | (lengths == 0))
    if len(rest):
        codes, distinct = coded(cut(data, starts[rest], ends[rest]))
        result[rest] = hashed(distinct)[codes]
    return result


def _hash_3(eight, first, n) -> np.ndarray:
    value, size = eight[first], n.astype(np.uint64)
    byte = np.uint64(255)
    middle = value >> (size >> np.uint64(1)) * np.uint64(8) & byte
    last = value >> (size - np.uint64(1)) * np.uint64(8) & byte
    h = ((value & byte) << np.uint64(16) | middle << np.uint64(24) | last | size << np.uint64(8)) ^ _FLIP_3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _hash_8(eight, first, n) -> np.ndarray:
    four = np.uint64(0xFFFFFFFF)
    h = ((eight[first + n - 4] & four) + (eight[first] << np.uint64(32))) ^ _FLIP_8
    h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
    h *= _MX2
    h ^= (h >> np.uint64(35)) + n.astype(np.uint64)
    h *= _MX2
    return h ^ h >> np.uint64(28)


def _hash_16(eight, first, n) -> np.ndarray:
    low, high = eight[first] ^ _FLIP_LOW, eight[first + n - 8] ^ _FLIP_HIGH
    half, four = np.uint64(32), np.uint64(0xFFFFFFFF)
    a, b, c, d = low & four, low >> half, high & four, high >> half
    ac, ad, bc = a * c, a * d, b * c
    middle = (ac >> half) + (ad & four) + (bc & four)
    upper = b * d + (ad >> half) + (bc >> half) + (middle >> half)
    h = n.astype(np.uint64) + low.byteswap() + high + (low * high ^ upper)
    h = (h ^ h >> np.uint64(37)) * _MX1
    return h ^ h >> np.uint64(32)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text number of every item, from the item bounds of texts."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each pair of neighbouring ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        filled = np.full(max(n, 1024), base, dtype=np.uint64)
        filled[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(filled)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of ``width`` consecutive item hashes, one per full window."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _powers(_MULTIPLIER, n), out=total[1:])
    return mixed((total[width:] - total[:-width]) * _powers(_INVERSE, n - width + 1))


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
