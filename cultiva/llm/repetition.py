"""Quality rules: how much of a text repeats itself, found with suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cultiva.llm.kernels import (
    arrow_map, carried, coded, cut, line_spans, owners, sums, text_blocks, word_spans,
)

# Production limits. The first two belong to the base rules, the last three to the
# suffix-array rule.
MIN_WORDS = 50
MAX_REPEAT_WORDS_PCT = 50
REPEAT_WORDS = 8
MAX_COVERED_PCT = 50
MAX_LONGEST_PCT = 30

BLOCK_BYTES = 4 << 20
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)


def suffix_array(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of many texts in a row, and its longest common prefixes.

    ``codes`` holds the items of all texts, ``bounds`` the text bounds; a suffix
    ends with its text and is compared inside it only, so the array goes text by
    text. ``lcp[i]`` is the prefix that suffix ``i`` of the array shares with the
    one before it, 0 for the first of a text.

    Prefix doubling: the rank of 2k items comes from two ranks of k items, where
    the end of the text ranks lowest. A suffix alone in its group keeps its rank
    and leaves the next rounds, so later rounds sort repeats only. The ranks of
    all rounds give common prefixes by descending through the powers of two.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = owners(bounds)
    end = bounds[1:][text]
    alive = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # the group's first place, by suffix in ``alive``
    key = text * (int(codes.max()) + 1) + codes
    ranks = np.zeros(n, dtype=np.int32)
    levels: list[np.ndarray] = []
    k = 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered, old = key[order], group[order]
        here = np.arange(len(order))
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        opens = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.maximum.accumulate(np.where(new, here, 0))
        place = old + first - np.maximum.accumulate(np.where(opens, here, 0))
        ranks[alive[order]] = place
        levels.append(ranks.copy())
        shared = ~(new & np.concatenate([new[1:], [True]]))
        if not shared.any():
            break
        alive, group = alive[order[shared]], place[shared]
        follow = alive + k
        after = np.where(follow < end[alive], ranks[np.minimum(follow, n - 1)].astype(np.int64) + 1, 0)
        key = group * (n + 1) + after
        k *= 2
    order = np.argsort(ranks, kind="stable")
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[1:], order[:-1]
    together = np.flatnonzero(text[a] == text[b])
    lcp[together + 1] = _common(levels, a[together], b[together])
    return order, lcp


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and ``b`` of one text.

    Equal ranks of level j mean 2^j equal items: two suffixes of a text differ in
    length, so neither of them can have ended.
    """
    lcp = np.zeros(len(a), dtype=np.int64)
    open_ = np.arange(len(a))
    last = len(levels[0]) - 1
    for j in range(len(levels) - 1, -1, -1):
        x, y = a[open_] + lcp[open_], b[open_] + lcp[open_]
        same = (x <= last) & (y <= last)
        same &= levels[j][np.minimum(x, last)] == levels[j][np.minimum(y, last)]
        lcp[open_[same]] += 1 << j
    return lcp


def repeats(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, lengths)`` of the longest repeat at every place where one starts.

    The longest repeat at a suffix is the larger of its two common prefixes, that
    is, the string of its innermost LCP interval; together these spans cover what
    all maximal repeated substrings of ``least`` items or more cover.
    """
    order, lcp = suffix_array(codes, bounds)
    longest = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if len(lcp) else lcp
    keep = longest >= least
    return order[keep], longest[keep]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places the union of the spans covers."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0


def _profile(batches: Iterator[pa.RecordBatch], text: str, limits: dict, drop: list[str]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        starts, ends, word_bounds = word_spans(data, bounds)
        codes = coded(cut(data, starts, ends))[0]
        n_words = np.diff(word_bounds)

        def total(per_word):
            return sums(per_word.astype(np.int64), word_bounds)

        at, length = repeats(codes, word_bounds, 3)
        short = covered(at, length, len(codes))
        long = length >= limits["repeat_words"]
        wide = covered(at[long], length[long], len(codes))
        longest = np.zeros(len(n_words), dtype=np.int64)
        np.maximum.at(longest, owners(word_bounds)[at], length)

        first_byte = ((data & 0xC0) != 0x80).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(first_byte)])
        line_starts, line_ends, line_bounds = line_spans(data, bounds)
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_codes = coded(cut(data, line_starts, line_ends))[0].astype(np.int64)
        pair = owners(line_bounds) * (len(line_codes) + 1) + line_codes
        first = np.zeros(len(pair), dtype=bool)
        first[np.unique(pair, return_index=True)[1]] = True

        n_repeat, n_covered = total(short), total(wide)
        failed = (n_words < limits["min_words"]) | (100 * n_repeat > limits["max_repeat_words_pct"] * n_words)
        kept = (
            ~failed
            & (100 * n_covered <= limits["max_covered_pct"] * n_words)
            & (100 * longest <= limits["max_longest_pct"] * n_words)
        )
        columns = [
            n_words,
            total(before[ends] - before[starts]),
            sums(SYMBOL[data].astype(np.int64), bounds),
            sums((has_word & ~first).astype(np.int64), line_bounds),
            n_repeat,
            n_covered,
            longest,
        ]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out = rows.drop_columns(drop)
        for name, values in zip(names, [*columns, failed, kept]):
            kind = pa.bool_() if values.dtype == bool else pa.int64()
            out = out.append_column(name, pa.array(values, kind))
        yield from out.combine_chunks().to_batches()


def repetition_profile(
    samples: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    min_words: int = MIN_WORDS,
    max_repeat_words_pct: int = MAX_REPEAT_WORDS_PCT,
    repeat_words: int = REPEAT_WORDS,
    max_covered_pct: int = MAX_COVERED_PCT,
    max_longest_pct: int = MAX_LONGEST_PCT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Word, symbol and repetition counts of every isolation text, and a verdict.

    One row per input row: ``key``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words`` (words inside 3-word repeats),
    ``n_covered_words`` (words inside repeats of ``repeat_words`` words or more),
    ``longest_repeat`` (words), ``base_failed`` and ``kept``. A word is a run of
    anything but ASCII white space. A text fails the base rules with fewer than
    ``min_words`` words or more than ``max_repeat_words_pct`` percent of repeated
    words; it is kept if it passes them, at most ``max_covered_pct`` percent of its
    words lie in long repeats, and the longest repeat is at most
    ``max_longest_pct`` percent of its words.

    A null or empty text has zero counts and fails. Repeated rows and null keys are
    kept as rows of their own. Columns named in ``carry`` come back as they are (their
    names must not be those above), the others are ignored. No
    shuffle: every text stands alone, and suffixes are sorted block by block.
    """
    limits = {
        "min_words": min_words,
        "max_repeat_words_pct": max_repeat_words_pct,
        "repeat_words": repeat_words,
        "max_covered_pct": max_covered_pct,
        "max_longest_pct": max_longest_pct,
    }
    if repeat_words < 3:
        raise ValueError("repeat_words must be 3 or more")
    chosen, fields, drop = carried(samples, key, text, carry)
    return arrow_map(chosen, partial(_profile, text=text, limits=limits, drop=drop), f"{fields}, {SCHEMA}")
