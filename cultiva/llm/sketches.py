"""Count-min sketches: built per partition, merged by segments, looked up as bitmaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from cultiva.llm.kernels import arrow_map, mixed
from cultiva.session import Scratch

SEGMENT = 1 << 16
_ODD = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
HELD_HASHES = 1 << 20
# Jobs in which the driver fetches what was merged.
FETCHES = 32


def cells(h: np.ndarray, row: int, log_width: int) -> np.ndarray:
    """Cell of every hash in one row of a sketch."""
    return mixed(h ^ np.uint64(_ODD[row])) >> np.uint64(64 - log_width)


class RepeatedCells:
    """Which cells of a merged sketch were hit twice or more, one bit per cell."""

    def __init__(self, depth: int, log_width: int):
        self.log_width = log_width
        self.bits = np.zeros((depth, max(1, (1 << log_width) // 8)), dtype=np.uint8)

    def put(self, row: int, segment: int, bits: bytes) -> None:
        at = segment * (SEGMENT // 8)
        self.bits[row, at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Whether the sketch estimates two or more for each hash; never too low."""
        found = np.ones(len(h), dtype=bool)
        for row in range(len(self.bits)):
            at = np.flatnonzero(found)
            cell = cells(h[at], row, self.log_width)
            byte = self.bits[row][cell >> np.uint64(3)]
            found[at] = (byte >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1
        return found


def _partial(batches: Iterator[pa.RecordBatch], hashes: Callable, depth: int, log_width: int):
    """Sparse sketches of what this task reads, a row per segment with a hit."""
    held: list[np.ndarray] = []
    size = 0
    for h in hashes(batches):
        held.append(h)
        size += len(h)
        if size > HELD_HASHES:
            yield from segments(np.concatenate(held), depth, log_width)
            held, size = [], 0
    if size:
        yield from segments(np.concatenate(held), depth, log_width)


def segments(h: np.ndarray, depth: int, log_width: int) -> Iterator[pa.RecordBatch]:
    """Sparse sketch of ``h``: cells hit once and more often, by segments."""
    for row in range(depth):
        hit, n = np.unique(cells(h, row, log_width), return_counts=True)
        segment = (hit >> np.uint64(16)).astype(np.int64)
        within = (hit & np.uint64(SEGMENT - 1)).astype(np.uint16)
        names, starts = np.unique(segment, return_index=True)
        stops = np.append(starts[1:], len(segment))
        once, more = [], []
        for a, b in zip(starts, stops):
            part, single = within[a:b], n[a:b] == 1
            once.append(part[single].tobytes())
            more.append(part[~single].tobytes())
        yield pa.record_batch(
            {
                "row": pa.array(np.full(len(names), row), pa.int32()),
                "segment": pa.array(names, pa.int32()),
                "once": pa.array(once, pa.binary()),
                "more": pa.array(more, pa.binary()),
            }
        )


def added_hits(counts: np.ndarray, once: bytes, more: bytes) -> None:
    """Add the hits of one partial sketch to the counts of a segment, up to 2."""
    single = np.frombuffer(once, dtype=np.uint16)
    counts[single] = np.minimum(counts[single] + 1, 2)
    counts[np.frombuffer(more, dtype=np.uint16)] = 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, segment) to one bitmap per segment."""
    key, counts = None, np.zeros(SEGMENT, dtype=np.uint8)

    def done():
        return pa.record_batch(
            {
                "row": pa.array([key[0]], pa.int32()),
                "segment": pa.array([key[1]], pa.int32()),
                "bits": pa.array([np.packbits(counts >= 2).tobytes()], pa.binary()),
            }
        )

    for batch in batches:
        for row, segment, once, more in zip(*(batch.column(c).to_pylist() for c in ("row", "segment", "once", "more"))):
            if key != (row, segment):
                if key is not None:
                    yield done()
                key, counts = (row, segment), np.zeros(SEGMENT, dtype=np.uint8)
            added_hits(counts, once, more)
    if key is not None:
        yield done()


def fetched(df: DataFrame) -> Iterator[Row]:
    """Rows of a table of bounded size, one after another; made by all executors at once.

    A local iterator alone starts a job for each partition, one by one.
    """
    scratch = Scratch(df.sparkSession)
    yield from scratch.written(df).coalesce(FETCHES).toLocalIterator(prefetchPartitions=True)
    scratch.clear()


def merged_sketch(df: DataFrame, hashes: Callable, depth: int, log_width: int) -> RepeatedCells:
    """Count-min sketch over all hashes that ``hashes(batches)`` yields in any task.

    Every task sends sparse partial sketches by segments; segments are added up on
    the executors, and one bit per cell comes back: ``depth * 2 ** log_width`` bits
    whatever the input, so the result can be broadcast.
    """
    if not 16 <= log_width <= 32 or not 1 <= depth <= len(_ODD):
        raise ValueError("log_width must lie between 16 and 32, depth between 1 and 4")
    parts = arrow_map(
        df,
        partial(_partial, hashes=hashes, depth=depth, log_width=log_width),
        "row int, segment int, once binary, more binary",
    )
    merged = arrow_map(
        parts.repartition("row", "segment").sortWithinPartitions("row", "segment"),
        _merge,
        "row int, segment int, bits binary",
    )
    sketch = RepeatedCells(depth, log_width)
    for found in fetched(merged):
        sketch.put(found["row"], found["segment"], bytes(found["bits"]))
    return sketch
