"""Periodic runs of words, caught online by blocks whose lengths are powers of two."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from cultiva.llm.kernels import arrow_map, carried, coded, cut, mixed, text_blocks, word_spans

# Production limits: words of a run at least, and how often its period fits at least.
MIN_LENGTH = 24
MIN_EXPONENT = 3

BLOCK_BYTES = 4 << 20
# Comparisons of catchers with suffixes held at once.
COMPARED = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string"
)


class Prefixes:
    """Hash of any stretch of words in two look-ups (polynomial over the words so far)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.full(n + 1, _STEP, dtype=np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.total[1:])

    def suffixes(self, size: int) -> np.ndarray:
        """Hash of the last ``size`` words after every append, by their first word.

        Equal stretches at different places agree after scaling to the last power.
        """
        n = len(self.total) - 1
        if n < size:
            return np.zeros(0, dtype=np.uint64)
        return (self.total[size:] - self.total[:-size]) * self.powers[n - size :: -1]

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from ``a`` and from the later ``b`` agree."""
        first = (self.total[a + size] - self.total[a]) * self.powers[b - a]
        return first == self.total[b + size] - self.total[b]


def _caught(hashes, catchers, size, low, limit, covered) -> tuple[np.ndarray, np.ndarray]:
    """``(catcher, period)`` of every suffix that repeats the block of a catcher.

    A row per catcher, a column per appended word: column ``d`` compares the block
    with the suffix that ends ``low + d`` words after the block did. ``covered`` is
    the largest period already explained by a run of a shorter period.
    """
    width = int(limit.max()) - low + 1
    suffix = sliding_window_view(np.concatenate([hashes, np.zeros(width, dtype=np.uint64)]), width)
    step = max(1, COMPARED // width)
    at, periods = [], []
    for i in range(0, len(catchers), step):
        rows = catchers[i : i + step]
        hit = suffix[rows + low] == hashes[rows][:, None]
        row, column = np.nonzero(hit)
        period = column + low
        keep = (period <= limit[i + row]) & (period > covered[i + row])
        at.append(i + row[keep])
        periods.append(period[keep])
    return np.concatenate(at), np.concatenate(periods)


def _extended(prefixes: Prefixes, left: np.ndarray, right: np.ndarray, period, low, high, size):
    """The whole stretch of equal words around ``left .. right``, ``period`` words apart.

    Less than ``size`` words can be missing at either end, otherwise the catcher
    before or behind would have reported too. Suffix comparisons advance by halves.
    """
    step = size
    while step > 1:
        step //= 2
        able = np.flatnonzero(left - step >= low)
        able = able[prefixes.same(left[able] - step, left[able] - step + period[able], step)]
        left[able] -= step
        able = np.flatnonzero(right + period + step <= high)
        able = able[prefixes.same(right[able], right[able] + period[able], step)]
        right[able] += step
    return left, right


def periodic_stretches(
    codes: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int
) -> np.ndarray:
    """Rows ``(text, start, end, period)`` of all runs, by text, start and period.

    ``codes`` holds the words of all texts, ``bounds`` the text bounds. The texts of
    a block advance together. For periods from ``low`` to ``2 * low - 1`` the
    catchers are the completed blocks of ``low / 2`` words at multiples of that size
    (single words for periods 1 to 3): any ``low`` words hold such a block. Each
    appended word compares the new suffix with the catchers in reach; a suffix equal
    to a block is one more step of a square whose halves lie ``period`` words
    apart, and steps of neighbouring catchers with the same period merge into one
    run. Its ends come from suffix comparisons, and the words themselves are compared
    in the end, so equal hashes never decide.

    A catcher inside a run of a period no longer than its block skips repeats within
    that run: two periods that overlap so far have a common divisor that is a
    period too (Fine and Wilf), so nothing primitive is lost and a text of one
    repeated word costs no more than others.
    """
    n_words = np.diff(bounds)
    found: list[np.ndarray] = []
    if len(codes) == 0 or n_words.max() < min_exponent:
        return np.zeros((0, 4), dtype=np.int64)
    prefixes = Prefixes(codes)
    reach = np.zeros(len(codes), dtype=np.int64)  # end of the widest run so far around each word
    low = 1
    while low <= int(n_words.max()) // min_exponent:
        size = max(1, low // 2)
        texts = np.flatnonzero(n_words // min_exponent >= low)
        per_text = np.maximum(0, (n_words[texts] - low) // size)
        text = np.repeat(texts, per_text)
        number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        catchers = bounds[text] + number * size
        limit = np.minimum(
            np.minimum(2 * low - 1, n_words[text] // min_exponent), bounds[text + 1] - size - catchers
        )
        hashes = prefixes.suffixes(size)
        at, period = _caught(hashes, catchers, size, low, limit, reach[catchers] - size - catchers)
        if len(at):
            # Catchers are numbered with a gap after each text, so runs never cross texts.
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            place = at + text[at]
            opens = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(period) != 0)])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(at)) - 1
            period, blocks = period[first], last - first + 1
            least = np.maximum(min_length, min_exponent * period) - period
            able = blocks >= np.maximum(1, (least - size + 1) // size)
            first, last, period, least = first[able], last[able], period[able], least[able]
            owner = text[at[first]]
            left, right = _extended(
                prefixes, catchers[at[first]], catchers[at[last]] + size, period,
                bounds[owner], bounds[owner + 1], size,
            )
            for t, a, b, p in zip(owner, left, right, period):
                found += _verified(codes, t, a, b, p, min_length, min_exponent)
            for _, a, b, p in found:
                if p <= low:
                    reach[a:b] = np.maximum(reach[a:b], b)
        low *= 2
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    runs = np.array(found, dtype=np.int64)
    # A stretch found with several periods has the smallest one.
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
    new = np.concatenate([[True], (np.diff(runs[:, 1]) != 0) | (np.diff(runs[:, 2]) != 0)])
    runs = runs[new]
    runs[:, 1:3] -= bounds[runs[:, 0]][:, None]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _verified(codes, text, left, right, period, min_length, min_exponent) -> list[tuple]:
    """Compare the words of a caught stretch; cut it where hashes agreed by chance."""
    equal = codes[left:right] == codes[left + period : right + period]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    runs = []
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a + period >= max(min_length, min_exponent * period):
            runs.append((text, left + a, left + b + period, period))
    return runs


def _kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 1] + runs[:, 3], 1)
    np.add.at(depth, runs[:, 2], -1)
    return np.cumsum(depth[:-1]) == 0


def _collapse(batches: Iterator[pa.RecordBatch], text, min_length, min_exponent, drop) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        starts, ends, word_bounds = word_spans(data, bounds)
        codes = coded(cut(data, starts, ends))[0]
        runs = periodic_stretches(codes, word_bounds, min_length, min_exponent)
        shifted = runs.copy()
        shifted[:, 1:3] += word_bounds[runs[:, 0]][:, None]
        kept = _kept_words(len(codes), shifted)
        out = rows.drop_columns(drop)
        per_text = np.bincount(runs[:, 0], minlength=len(rows))
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(runs[:, 1]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])],
                names=["start", "length", "period"],
            ),
        )
        out = out.append_column("n_words", pa.array(np.diff(word_bounds), pa.int64()))
        out = out.append_column("runs", lists)
        out = out.append_column("collapsed_text", _joined(data, starts[kept], ends[kept], np.concatenate(
            [[0], np.cumsum(kept)])[word_bounds]))
        yield from out.combine_chunks().to_batches()


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_bounds: np.ndarray) -> pa.Array:
    """The words of every text joined by one blank."""
    length = ends - starts + 1  # each word brings a blank, the last of a text leaves it out
    offsets = np.concatenate([[0], np.cumsum(length)])
    filled = np.full(int(offsets[-1]), 32, dtype=np.uint8)
    within = np.ones(len(filled), dtype=bool)
    within[offsets[1:] - 1] = False
    words = cut(data, starts, ends)
    filled[within] = np.frombuffer(words.buffers()[2], dtype=np.uint8)[: int((ends - starts).sum())]
    some = np.diff(word_bounds) > 0
    drop = offsets[word_bounds[1:]][some] - 1
    keep = np.ones(len(filled), dtype=bool)
    keep[drop] = False
    sizes = np.diff(offsets[word_bounds]) - some
    joined = filled[keep]
    return pa.Array.from_buffers(
        pa.large_binary(), len(sizes),
        [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(joined)],
    ).cast(pa.binary()).cast(pa.string())


def periodic_runs(
    samples: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Stretches of isolation texts in which the same words come round again and again.

    One row per input row: ``key``, ``n_words``, ``runs`` and ``collapsed_text``. A
    word is a run of anything but ASCII white space, numbered from 0. A run is a
    stretch whose words equal those ``period`` words on, for the smallest such
    ``period``, of ``max(min_length, min_exponent * period)`` words or more, that
    cannot grow at either end; ``runs`` lists ``start``, ``length`` and ``period`` by
    start, then period. Runs may overlap. ``collapsed_text`` joins the words outside
    all runs and the first period of every run by one blank; a word in the first
    period of one run goes if another run drops it.

    A null or empty text has no words, no runs and an empty collapsed text. Repeated
    rows and null keys are kept as rows of their own. Columns named in ``carry`` come
    back as they are; a name of the result among them is an error. No shuffle: every
    text stands alone, and its memory grows with the block, not with the periods.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run repeats its period twice or more and has a word or more")
    chosen, fields, drop = carried(samples, key, text, carry)
    taken = {"n_words", "runs", "collapsed_text"} & {key, *carry}
    if taken:
        raise ValueError(f"columns of the result: {sorted(taken)}")
    work = partial(_collapse, text=text, min_length=min_length, min_exponent=min_exponent, drop=drop)
    return arrow_map(chosen, work, f"{fields}, {SCHEMA}")
