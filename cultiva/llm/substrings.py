"""Removal of word windows that occur more than once in a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.llm.kernels import (
    arrow_map, coded, cut, hashed, owners, sums, text_blocks, to_signed, window_hashes, word_spans,
)
from cultiva.llm.kernels import gather_ranges
from cultiva.llm.sketches import RepeatedCells, merged_sketch
from cultiva.llm.tables import written

WIDTH = 35
ANCHOR = 8
DEPTH = 3
LOG_ANCHOR_CELLS = 26
LOG_WINDOW_CELLS = 27
BLOCK_BYTES = 3 << 20
_PLACE_BITS = np.uint64(28)


class _Windows:
    """Word windows of a block, with the anchor of each.

    The anchor of a window is its run of ``ANCHOR`` words with the least hash, the
    first of equals. It depends on the window's words only, so wherever a window
    occurs, its anchor occurs at the same distance: a window cannot occur more often
    than its anchor does.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int):
        self.starts, self.ends, self.word_bounds = word_spans(data, bounds)
        codes, distinct = coded(cut(data, self.starts, self.ends))
        words = hashed(distinct)[codes]
        end = self.word_bounds[1:][owners(self.word_bounds)]
        n = max(0, len(words) - width + 1)
        self.at = np.flatnonzero(np.arange(n) + width <= end[:n])
        self.text = owners(self.word_bounds)[self.at]
        self.h = window_hashes(words, width)[self.at]
        self.words, self.width = words, width

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, number)``: distinct anchor places, and the one of every window."""
        if len(self.at) == 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        short = min(ANCHOR, self.width)
        grams = window_hashes(self.words, short)
        room = self.width - short + 1
        least = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= room:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < room:
            least = np.minimum(least[: len(least) - (room - span)], least[room - span :])
        place = (least[self.at] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        places, number = np.unique(place, return_inverse=True)
        return grams[places], number


def _blocks(batches, text, width) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, _Windows]]:
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        yield rows, data, bounds, _Windows(data, bounds, width)


def _anchor_hashes(batches, text: str, width: int) -> Iterator[np.ndarray]:
    for *_, windows in _blocks(batches, text, width):
        yield windows.anchors()[0]


def _candidates(windows: _Windows, anchors: RepeatedCells) -> np.ndarray:
    """Windows whose anchor the sketch estimates to occur again."""
    hashes, number = windows.anchors()
    return np.flatnonzero(anchors.repeated(hashes)[number])


def _window_hashes(batches, text: str, width: int, anchors) -> Iterator[np.ndarray]:
    for *_, windows in _blocks(batches, text, width):
        yield windows.h[_candidates(windows, anchors.value)]


def _estimated(windows: _Windows, anchors: RepeatedCells, counts: RepeatedCells) -> np.ndarray:
    """Windows that both sketches estimate to occur again."""
    some = _candidates(windows, anchors)
    return some[counts.repeated(windows.h[some])]


def _occurrences(batches, text: str, width: int, anchors, counts) -> Iterator[pa.RecordBatch]:
    """Distinct estimated windows of a block: hash, occurrences, and where the first one is."""
    for rows, _, _, windows in _blocks(batches, text, width):
        some = _estimated(windows, anchors.value, counts.value)
        h, first, n = np.unique(windows.h[some], return_index=True, return_counts=True)
        where = some[first]
        texts = rows.column("_text").to_numpy()[windows.text[where]]
        place = windows.at[where] - windows.word_bounds[windows.text[where]]
        yield pa.record_batch(
            {
                "h": pa.array(to_signed(h)),
                "n": pa.array(np.minimum(n, 2), pa.int32()),
                "_text": pa.array(texts),
                "place": pa.array(place, pa.int32()),
            }
        )


def _remove(batches, text: str, width: int, anchors, counts) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds, windows in _blocks(batches, text, width):
        some = _estimated(windows, anchors.value, counts.value)
        # Places where the second pass found that the estimate was too high.
        alone = rows.column("alone").combine_chunks()
        per_text = pc.fill_null(pc.list_value_length(alone), 0).to_numpy().astype(np.int64)
        places = alone.flatten().to_numpy().astype(np.int64)
        false = np.repeat(windows.word_bounds[:-1], per_text) + places
        covering = np.setdiff1d(windows.at[some], false, assume_unique=False)
        n = len(windows.starts)
        depth = np.zeros(n + 1, dtype=np.int32)
        np.add.at(depth, covering, 1)
        np.add.at(depth, covering + width, -1)
        removed = np.cumsum(depth[:-1]) > 0
        kept = np.flatnonzero(~removed)
        lengths = (windows.ends - windows.starts)[kept]
        text_of = owners(windows.word_bounds)[kept]
        # A space after every kept word but the last of its text.
        space = np.ones(len(kept), dtype=np.int64)
        space[np.flatnonzero(np.append(text_of[1:] != text_of[:-1], True))[: len(kept)]] = 0
        to = np.cumsum(lengths + space) - lengths - space
        joined = np.full(int((lengths + space).sum()), ord(" "), dtype=np.uint8)
        joined[gather_ranges(to, lengths)] = data[gather_ranges(windows.starts[kept], lengths)]
        sizes = np.bincount(text_of, weights=lengths + space, minlength=len(bounds) - 1).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        kept_text = pa.Array.from_buffers(
            pa.large_string(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(joined)]
        )
        out = rows.drop_columns([text, "alone"])
        out = out.append_column("n_words", pa.array(np.diff(windows.word_bounds), pa.int64()))
        out = out.append_column("n_removed", pa.array(sums(removed, windows.word_bounds), pa.int64()))
        out = out.append_column("kept_text", kept_text.cast(pa.string()))
        yield from out.combine_chunks().to_batches()


def remove_repeated_windows(
    samples: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    width: int = WIDTH,
    log_anchor_cells: int = LOG_ANCHOR_CELLS,
    log_window_cells: int = LOG_WINDOW_CELLS,
) -> DataFrame:
    """``(key, n_words, n_removed, kept_text)``: texts without repeated word windows.

    A window is ``width`` consecutive words (runs of anything but ASCII white space,
    unchanged) of one text. Every word covered by a window whose words also start
    anywhere else, in the same text or another, is removed; all windows are judged
    on the input. ``kept_text`` has the other words joined by single spaces.

    Two count-min sketches, merged from all partitions, come first. One counts
    anchors, a thinned choice of short runs such that every window has one; the
    other counts the windows whose anchor seems to occur again. Both only ever
    overestimate, so no repeated window is lost. The windows estimated repeated, and
    only those, are grouped exactly by a 64-bit hash; groups of one are the false
    alarms, which go back to their texts. Groups are added up before the shuffle, so
    a window that a third of all texts hold is one row per block.

    The sketches have fixed sizes, ``3 * 2 ** log_cells`` bits each, and are
    broadcast. On more text than they are wide for, more windows are grouped
    exactly and the result stays the same; double the cells with the text to keep
    the share of false alarms.

    A null or empty text has 0 words and an empty kept text; so has one removed
    altogether. Repeated rows repeat each other's windows. Null keys are kept; other
    columns are ignored.
    """
    spark = samples.sparkSession
    chosen = samples.select(key, text)
    # Texts shorter than a window have none, but their rows come back.
    texts = chosen.select(text, F.xxhash64(text).alias("_text"))
    anchors = spark.sparkContext.broadcast(
        merged_sketch(texts, partial(_anchor_hashes, text=text, width=width), DEPTH, log_anchor_cells)
    )
    counts = spark.sparkContext.broadcast(
        merged_sketch(
            texts, partial(_window_hashes, text=text, width=width, anchors=anchors), DEPTH, log_window_cells
        )
    )
    found = arrow_map(
        texts,
        partial(_occurrences, text=text, width=width, anchors=anchors, counts=counts),
        "h bigint, n int, _text bigint, place int",
    )
    single = (
        found.groupBy("h")
        .agg(F.sum("n").alias("n"), F.min("_text").alias("_text"), F.min("place").alias("place"))
        .filter("n = 1")
    )
    false = written(single.groupBy("_text").agg(F.collect_list("place").alias("alone")))
    kind = chosen.schema[key].dataType.simpleString()
    judged = (
        chosen.withColumn("_text", F.xxhash64(text)).join(false, "_text", "left").select(key, text, "alone")
    )
    return arrow_map(
        judged,
        partial(_remove, text=text, width=width, anchors=anchors, counts=counts),
        f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_text string",
    )
