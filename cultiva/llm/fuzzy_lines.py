"""Removal of lines that nearly repeat another line of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.llm.jaccard import _bucket_runs, _class_hashes, _marked, _pair_hashes, _whole
from cultiva.llm.kernels import (
    arrow_map, coded, cut, gather_ranges, hashed_spans, line_spans, mixed, owners, text_blocks, to_signed,
    word_spans,
)
from cultiva.llm.sketches import merged_sketch
from cultiva.llm.tables import components, written
from cultiva.session import Scratch

MIN_WORDS = 3
FUZZY_WORDS = 8
DISTANCE = 3
BLOCKS = 5
HALF_DISTANCE = 14
EDIT_PERCENT = 90
# Four cells of the sketch for every key, within bounds: the share of false alarms stays.
CELLS_PER_KEY = 4
LEAST_LOG_KEY_CELLS = 20
MOST_LOG_KEY_CELLS = 29
LOG_WANTED_CELLS = 24
BLOCK_BYTES = 4 << 20

# What normalising leaves of each byte: letters in lower case, digits, all signs and
# white space as blanks. Folding, which only finds candidates, makes every digit a 0.
_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[128:] = np.arange(128, 256)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[48:58] = 48


# The bits of a byte, highest first, as the eight bytes of a number: numbers of up to 255
# words are added up bit by bit without a carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_LANE_WORDS = 255

# Kinds of keys, the last two bits of a token.
_SIMHASH, _HALF, _SHORT = 0, 1, 2
_KIND = np.uint64(3)
# Of the signature of a short line: 56 bits for its pairs of bytes, then its length.
_PAIR_BITS = 56
_PAIRS = np.uint64((1 << _PAIR_BITS) - 1)
_LONGEST = 127
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_signs(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word the bits of its pairs of bytes, its code points, and whether all are ASCII.

    The blanks around a word belong to its pairs, so the bits of a line are those of its words.
    """
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    data = np.frombuffer(b" " + b" ".join(words.to_pylist()) + b" ", dtype=np.uint8)
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    pairs = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    bits = np.uint64(1) << mixed(pairs * _ODD) % np.uint64(_PAIR_BITS)
    points = np.add.reduceat((data[:-1] & 0xC0) != 0x80, starts, dtype=np.int64) - 1
    return np.bitwise_or.reduceat(bits, starts), points, points == lengths


class _Lines:
    """Lines of a block of texts, normalised, with a hash per line."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, digits: bool = False):
        self.starts, self.ends, self.bounds = line_spans(data, bounds)
        normal = (_NORMAL if digits else _FOLD[_NORMAL])[data]
        word_starts, word_ends, _ = word_spans(normal, bounds)
        # A line feed has become a blank, so no word runs over a line's end.
        exact = hashed_spans(normal, word_starts, word_ends)
        self.words = exact.copy()
        numbers = np.flatnonzero((normal >= 48) & (normal <= 57))
        folded = np.unique(np.searchsorted(word_starts, numbers, "right") - 1)
        self.words[folded] = hashed_spans(_FOLD[normal], word_starts[folded], word_ends[folded])
        self.normal, self.word_starts, self.word_ends = normal, word_starts, word_ends
        self.first = np.searchsorted(word_starts, self.starts)
        self.last = np.searchsorted(word_starts, self.ends)
        # An empty line at the same byte as the next line has no words.
        self.last = np.maximum(self.first, self.last)
        self.n_words = self.last - self.first
        self.place = np.arange(len(self.words)) - np.repeat(self.first, self.n_words)
        self.cls = self._sequences(exact)

    def _sequences(self, words: np.ndarray) -> np.ndarray:
        """Hash of the words of every line in their order."""
        weight = mixed(words + (self.place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        total = np.zeros(len(weight) + 1, dtype=np.uint64)
        np.cumsum(weight, out=total[1:])
        return mixed(total[self.last] - total[self.first] + self.n_words.astype(np.uint64))

    def candidates(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What near lines agree on: a SimHash (of short lines the signature of their
        letters) and keys of parts of the line, all keys after each other with their number
        per line. Keys are of folded words."""
        sim, n = np.zeros(len(of), dtype=np.uint64), self.n_words[of]
        long, short = np.flatnonzero(n >= FUZZY_WORDS), np.flatnonzero(n < FUZZY_WORDS)
        sim[long] = self.simhashes(of[long])
        sim[short] = self._signatures(of[short])
        per_line = np.where(n >= FUZZY_WORDS, 3, n + 1)
        keys = np.zeros(int(per_line.sum()), dtype=np.uint64)
        at = np.cumsum(per_line) - per_line
        if len(long):
            keys[at[long][:, None] + np.arange(3)] = self._halves(of[long])
        if len(short):
            keys[gather_ranges(at[short], per_line[short])] = self._but_one(of[short])
        return sim, keys, per_line

    def _halves(self, of: np.ndarray) -> np.ndarray:
        """Keys of the first and the last words, half of the line's or of one word more.

        A line and one that has a run of other words in one half, or one more word in
        it, have such a half in common.
        """
        first, last, n = self.first[of], self.last[of], self.n_words[of]
        place = self.place.astype(np.uint64) + np.uint64(1)
        back = np.repeat(self.n_words, self.n_words).astype(np.uint64) - place + np.uint64(1)
        zero = np.zeros(1, dtype=np.uint64)
        ahead = np.concatenate([zero, np.cumsum(mixed(self.words + place * _ODD), dtype=np.uint64)])
        behind = np.concatenate([zero, np.cumsum(mixed(self.words - back * _ODD), dtype=np.uint64)])

        def head(m):
            return mixed(ahead[first + m] - ahead[first] + m.astype(np.uint64) * np.uint64(2))

        def tail(m):
            return mixed(behind[last] - behind[last - m] + m.astype(np.uint64) * np.uint64(2) + np.uint64(1))

        third = np.where(n % 2 == 0, tail(n // 2 + 1), head((n + 1) // 2))
        return np.column_stack([head(n // 2), tail((n + 1) // 2), third]) & ~_KIND | np.uint64(_HALF)

    def _but_one(self, of: np.ndarray) -> np.ndarray:
        """Keys of all words, and of all but one: lines that differ in one word, or by one, share one."""
        first, n = self.first[of], self.n_words[of]
        place = self.place.astype(np.uint64)
        zero = np.zeros(1, dtype=np.uint64)
        here = np.concatenate([zero, np.cumsum(mixed(self.words + (place + np.uint64(1)) * _ODD), dtype=np.uint64)])
        moved = np.concatenate([zero, np.cumsum(mixed(self.words + place * _ODD), dtype=np.uint64)])
        start, count = np.repeat(first, n + 1), np.repeat(n, n + 1)
        left_out = gather_ranges(np.zeros(len(of), dtype=np.int64), n + 1)  # the last: none
        total = here[start + left_out] - here[start]
        some = left_out < count
        end = (start + count)[some]
        total[some] += moved[end] - moved[(start + left_out)[some] + 1]
        return mixed(total + (count - some).astype(np.uint64)) & ~_KIND | np.uint64(_SHORT)

    def _signatures(self, of: np.ndarray) -> np.ndarray:
        """Pairs of bytes and length of a line; from them follows the least number of edits."""
        if len(of) == 0:
            return np.zeros(0, dtype=np.uint64)
        by = np.argsort(of)
        of = of[by]
        n = self.n_words[of]
        words = gather_ranges(self.first[of], n)
        at, distinct = coded(cut(self.normal, self.word_starts[words], self.word_ends[words]))
        bits, points, ascii_only = _word_signs(distinct)
        edges = np.cumsum(n) - n
        length = np.minimum(np.add.reduceat(points[at], edges) + n - 1, _LONGEST)
        plain = np.logical_and.reduceat(ascii_only[at], edges)
        found = np.bitwise_or.reduceat(bits[at], edges)
        result = np.empty(len(of), dtype=np.uint64)
        result[by] = found | (length * 2 + ~plain).astype(np.uint64) << np.uint64(_PAIR_BITS)
        return result

    def simhashes(self, of: np.ndarray) -> np.ndarray:
        """64-bit SimHash of the words of some lines."""
        result = np.zeros(len(of), dtype=np.uint64)
        n = self.n_words[of]
        few = np.flatnonzero(n <= _LANE_WORDS)
        sizes = n[few]
        ends = np.cumsum(sizes)
        words = mixed(self.words[gather_ranges(self.first[of[few]], sizes)]).view(np.uint8).reshape(-1, 8)
        votes = np.empty((len(few), 8), dtype=np.uint64)
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        for k in range(8):
            np.cumsum(_LANES[words[:, k]], out=total[1:])
            votes[:, k] = total[ends] - total[ends - sizes]
        most = 2 * votes.view(np.uint8).reshape(-1, 64).astype(np.int16) > sizes[:, None]
        result[few] = np.packbits(most, axis=1).view(np.uint64).ravel()
        for i in np.flatnonzero(n > _LANE_WORDS):
            words = mixed(self.words[self.first[of[i]] : self.last[of[i]]]).view(np.uint8).reshape(-1, 8)
            ones = np.unpackbits(words, axis=1).sum(axis=0, dtype=np.int64)
            result[i] = np.packbits(2 * ones > n[i]).view(np.uint64)[0]
        return result

    def lengths(self, of: np.ndarray) -> np.ndarray:
        """Code points of some normalised lines."""
        sizes = np.concatenate([[0], np.cumsum(self.word_ends - self.word_starts)])
        rest = np.flatnonzero(self.normal & 0xC0 == 0x80)  # bytes that begin no code point
        rest = np.searchsorted(rest, self.ends[of]) - np.searchsorted(rest, self.starts[of])
        first, last = self.first[of], self.last[of]
        return sizes[last] - sizes[first] + np.maximum(last - first - 1, 0) - rest

    def normalised(self, line: int) -> str:
        words = [
            self.normal[a:b].tobytes()
            for a, b in zip(
                self.word_starts[self.first[line] : self.last[line]], self.word_ends[self.first[line] : self.last[line]]
            )
        ]
        return b" ".join(words).decode("utf-8", "replace")


def _new_lines(cls: np.ndarray, use: np.ndarray, seen: set) -> np.ndarray:
    fresh, first = np.unique(cls[use], return_index=True)
    known = np.fromiter((int(v) in seen for v in fresh), dtype=bool, count=len(fresh))
    seen.update(int(v) for v in fresh[~known])
    return use[first[~known]]


def _lines(batches, text: str, key: str, min_words: int, digits: bool) -> Iterator[pa.RecordBatch]:
    """Every line long enough to be judged; the first of its class here has what candidates are found by."""
    seen: set = set()
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        lines = _Lines(data, bounds, digits)
        judged = np.flatnonzero(lines.n_words >= min_words)
        fuzzy = _new_lines(lines.cls, judged, seen)
        sim = np.zeros(len(lines.cls), dtype=np.uint64)
        sim[fuzzy], keys, per_line = lines.candidates(fuzzy)
        n_keys = np.zeros(len(lines.cls), dtype=np.int64)
        n_keys[fuzzy] = per_line
        # Lines of ``fuzzy`` are in the order of their classes, rows in that of the text.
        place = np.zeros(len(lines.cls), dtype=np.int64)
        place[fuzzy] = np.cumsum(per_line) - per_line
        keys = keys[gather_ranges(place[judged], n_keys[judged])]
        offsets = np.concatenate([[0], np.cumsum(n_keys[judged])]).astype(np.int32)
        has = np.zeros(len(lines.cls), dtype=bool)
        has[fuzzy] = True
        fuzzy = np.flatnonzero(has)
        raw = np.zeros(len(lines.cls), dtype=np.uint64)
        raw[fuzzy] = hashed_spans(data, lines.starts[fuzzy], lines.ends[fuzzy])
        chars = np.zeros(len(lines.cls), dtype=np.int64)
        chars[fuzzy] = lines.lengths(fuzzy)
        owner = owners(lines.bounds)[judged]
        yield pa.record_batch(
            {
                key: rows.column(key).combine_chunks().take(pa.array(owner)),
                "_doc": rows.column("_doc").combine_chunks().take(pa.array(owner)),
                "line": pa.array(judged - lines.bounds[:-1][owner], pa.int32()),
                "cls": pa.array(to_signed(lines.cls[judged])),
                "sim": pa.array(to_signed(sim[judged]), pa.int64(), mask=~has[judged]),
                "raw": pa.array(to_signed(raw[judged]), pa.int64(), mask=~has[judged]),
                "chars": pa.array(chars[judged], pa.int32(), mask=~has[judged]),
                "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(to_signed(keys))),
            }
        )


def block_keys(sim: np.ndarray, distance: int = DISTANCE, blocks: int = BLOCKS) -> np.ndarray:
    """Keys of every SimHash, one column per choice of blocks.

    64 bits are cut into ``blocks``. At most ``distance`` of them differ between two
    hashes of that Hamming distance, so they agree on all bits of at least one choice
    of ``blocks - distance`` blocks.
    """
    masks, salts = _block_masks(distance, blocks)
    return mixed((sim[:, None] & masks) + salts)


@cache
def _block_masks(distance: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of every choice of blocks, and what tells its keys from those of the others."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks, salts = [], []
    for turn, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        masks.append(sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen))
        salts.append((turn + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    return np.array(masks, dtype=np.uint64), np.array(salts, dtype=np.uint64)


ROWS_AT_ONCE = 1 << 14
BYTES_AT_ONCE = 8 << 20


def _larger(batches) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: small arrays cost as many calls as large ones."""
    waiting, rows, size = [], 0, 0
    for batch in batches:
        waiting.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, rows, size = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the lines of a batch, each with the number of its line."""
    sim = batch.column("sim").to_numpy().view(np.uint64)
    lists = batch.column("keys")
    parts = lists.flatten().to_numpy().view(np.uint64)
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sim)), sizes)
    long = np.unique(owner[parts & _KIND == _HALF])
    blocks = block_keys(sim[long]) & ~_KIND
    return np.concatenate([parts, blocks.ravel()]), np.concatenate([owner, np.repeat(long, blocks.shape[1])])


def _key_hashes(batches) -> Iterator[np.ndarray]:
    for batch in _larger(batches):
        yield mixed(_tokens(batch)[0])


def _key_rows(batches, shared) -> Iterator[pa.RecordBatch]:
    for batch in _larger(batches):
        tokens, owner = _tokens(batch)
        some = np.flatnonzero(shared.value.repeated(mixed(tokens)))
        yield pa.record_batch(
            {
                "token": pa.array(to_signed(tokens[some])),
                "cls": batch.column("cls").take(pa.array(owner[some])),
                "sim": batch.column("sim").take(pa.array(owner[some])),
                "chars": batch.column("chars").take(pa.array(owner[some])),
            }
        )


SMALL_BUCKET = 32
PAIRS_AT_ONCE = 1 << 16


def _near(a: np.ndarray, b, token, percent: int) -> np.ndarray:
    """Whether two lines of a bucket may be similar, by what the kind of its key calls for.

    SimHashes differ in few bits. Signatures of short lines never refuse a similar
    pair: an edit of an ASCII line changes at most 4 pairs of bytes, of others 10.
    """
    a, b = a.view(np.uint64), np.asarray(b).view(np.uint64)
    kind = np.asarray(token).view(np.uint64) & _KIND
    differ = a ^ b
    limit = np.where(kind == _HALF, HALF_DISTANCE, DISTANCE)
    short = kind == _SHORT
    if short.any():
        head_a, head_b = (x >> np.uint64(_PAIR_BITS) for x in (a, b))
        longest = (np.maximum(head_a, head_b) >> np.uint64(1)).astype(np.int64)
        per_edit = np.where((head_a | head_b) & np.uint64(1), 10, 4)
        edits = np.where(longest < _LONGEST, (100 - percent) * longest // 100, 64)
        differ = np.where(short, differ & _PAIRS, differ)
        limit = np.where(short, per_edit * edits, limit)
    return np.bitwise_count(differ) <= limit


def _long_enough(a: np.ndarray, b, percent: int) -> np.ndarray:
    """Whether lines of these lengths can be similar at all: as :func:`similar` asks first."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return 100 * np.abs(a - b) <= (100 - percent) * np.maximum(a, b)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pa.record_batch({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})


def _pivots(cls: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For every row the row of its bucket's pivot."""
    order = mixed(cls.view(np.uint64))
    least = np.repeat(np.minimum.reduceat(order, cuts[:-1]), np.diff(cuts))
    chosen = np.flatnonzero(order == least)
    bucket = np.searchsorted(cuts, chosen, "right") - 1
    return np.repeat(chosen[np.unique(bucket, return_index=True)[1]], np.diff(cuts))


def _star_pairs(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of every line of a bucket with a pivot of it: linear in its rows."""
    columns = ("cls", "sim", "token", "chars")
    for whole in _bucket_runs(_larger(batches), columns, lambda held, names: [_whole(held, names)]):
        if whole is None:
            continue
        (cls, sim, token, chars), cuts = whole
        pivot = _pivots(cls, cuts)
        ok = (cls != cls[pivot]) & _long_enough(chars, chars[pivot], percent) & _near(sim, sim[pivot], token, percent)
        yield _pair_batch(cls[ok], cls[pivot[ok]])


def _in_first_bucket(a: np.ndarray, b: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Whether a near pair is reported by this bucket: by the first of the block keys it shares.

    Near SimHashes share a block key, so buckets of halves leave such pairs to it.
    """
    own = np.ones(len(a), dtype=bool)
    masks, salts = _block_masks(DISTANCE, BLOCKS)
    kind = token.view(np.uint64) & _KIND
    for lo in range(0, len(a), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        x, y, by = a[at].view(np.uint64), b[at].view(np.uint64), kind[at]
        differ = x ^ y
        first = (differ[:, None] & masks == 0).argmax(axis=1)
        mine = (mixed((x & masks[first]) + salts[first]) & ~_KIND) == token[at].view(np.uint64)
        near = np.bitwise_count(differ) <= DISTANCE
        own[at] = np.where(by == _SIMHASH, mine, (by != _HALF) | ~near)
    return own


class _Groups:
    """Components that grow by the links found in a task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def link(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


def _rest_links(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of a bucket between different components: one for every two that it unites.

    Lines are compared where they meet, so a bucket gives fewer links than it has rows,
    however many near pairs it holds.
    """
    columns = ("cls", "sim", "component", "token", "line")
    groups = _Groups()
    for whole in _bucket_runs(_larger(batches), columns, lambda held, names: [_whole(held, names)]):
        if whole is None:
            continue
        (cls, sim, component, token, line), cuts = whole
        chars = np.fromiter(map(len, line), dtype=np.int64, count=len(line))
        sizes = np.diff(cuts)
        left = np.repeat(cuts[1:], sizes) - np.arange(len(cls))  # rows to the bucket's end
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        pivot = _pivots(cls, cuts)
        a, b = [], []

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            # The pivot's own pairs were compared before.
            i, j = (x[(cls[i] != cls[pivot[i]]) & (cls[j] != cls[pivot[j]])] for x in (i, j))
            own = _in_first_bucket(sim[i], sim[j], token[i])
            for x, y in zip(i[own].tolist(), j[own].tolist()):
                if groups.root(int(component[x])) != groups.root(int(component[y])) and similar(line[x], line[y], percent):
                    groups.link(int(component[x]), int(component[y]))
                    a.append(x)
                    b.append(y)

        # Small buckets side by side: rows one apart, then two, and so on.
        for step in range(1, min(SMALL_BUCKET, int(sizes.max()))):
            i = np.flatnonzero(small & (left > step))
            i = i[(component[i] != component[i + step]) & _long_enough(chars[i], chars[i + step], percent)]
            ok = _near(sim[i], sim[i + step], token[i], percent)
            compare(i[ok], i[ok] + step)
        for k in np.flatnonzero(sizes > SMALL_BUCKET):
            at = slice(cuts[k], cuts[k + 1])
            names, number, n = np.unique(component[at], return_inverse=True, return_counts=True)
            turn = np.where(number == n.argmax(), -1, np.arange(len(number)))
            for i in np.flatnonzero(turn >= 0):
                # Who has had a turn has been held against this line.
                open_ = (number != number[i]) & ((turn < 0) | (turn > i))
                j = np.flatnonzero(open_ & _long_enough(chars[at], chars[at][i], percent)) + cuts[k]
                j = j[_near(sim[j], sim[at][i : i + 1], token[at][:1], percent)]
                compare(np.full(len(j), cuts[k] + i), j)
        yield _pair_batch(cls[a], cls[b])


def _near_rows(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of lines that have a near one in the bucket: only these can give a pair."""
    columns = ("cls", "sim", "token", "chars")
    for whole in _bucket_runs(_larger(batches), columns, lambda held, names: [_whole(held, names)]):
        if whole is None:
            continue
        (cls, sim, token, chars), cuts = whole
        sizes = np.diff(cuts)
        left = np.repeat(cuts[1:], sizes) - np.arange(len(cls))
        small = np.repeat(sizes <= SMALL_BUCKET, sizes)
        near, held = np.zeros(len(cls), dtype=bool), np.zeros(len(cls), dtype=bool)
        for step in range(1, min(SMALL_BUCKET, int(sizes.max()))):
            i = np.flatnonzero(small & (left > step))
            i = i[(cls[i] != cls[i + step]) & _long_enough(chars[i], chars[i + step], percent)]
            i = i[_near(sim[i], sim[i + step], token[i], percent)]
            near[i] = near[i + step] = True
        for k in np.flatnonzero(sizes > SMALL_BUCKET):
            at = slice(cuts[k], cuts[k + 1])
            names, sims, sizes_of, found = cls[at], sim[at], chars[at], near[at]
            some = max(1, min(SMALL_BUCKET, PAIRS_AT_ONCE // len(names)))
            # Many rows that are alike are found by the first of them.
            while len(open_ := np.flatnonzero(~found & ~held[at])):
                i = open_[:some]
                close = _long_enough(sizes_of[i, None], sizes_of, percent) & (names[i, None] != names)
                close &= _near(sims[i, None], sims, token[at][:1], percent)
                found |= close.any(axis=0)
                found[i] |= close.any(axis=1)
                held[at][i] = True
        rows = {"token": token, "cls": cls, "sim": sim, "chars": chars}
        yield pa.record_batch({name: pa.array(values[near]) for name, values in rows.items()})


def _wanted_lines(batches, text: str, wanted, digits: bool) -> Iterator[pa.RecordBatch]:
    """Lines with one of the wanted hashes of their bytes; only these are normalised."""
    seen: set = set()
    for _, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        starts, ends, _ = line_spans(data, bounds)
        some = np.flatnonzero(ends > starts)
        raw = np.zeros(len(starts), dtype=np.uint64)
        raw[some] = hashed_spans(data, starts[some], ends[some])
        some = np.sort(_new_lines(raw, some[wanted.value.repeated(raw[some])], seen))
        sizes = (ends - starts)[some]
        lines = _Lines(data[gather_ranges(starts[some], sizes)], np.concatenate([[0], np.cumsum(sizes)]), digits)
        yield pa.record_batch(
            {
                "cls": pa.array(to_signed(lines.cls)),
                "line": pa.array([lines.normalised(i) for i in range(len(some))], pa.string()),
            }
        )


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns, after common ends are cut off."""
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, sign in enumerate(a):
        where[sign] = where.get(sign, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for sign in b:
        match = where.get(sign, 0) | down
        across = ((match & up) + up ^ up) | match
        rise, fall = down | ~(across | up) & full, up & across
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        match = where.get(sign, 0) | down
        up, down = (fall | ~(match | across | rise)) & full, rise & (match | across)
    return distance


def within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``.

    Distances never fall along the diagonal that ends in the result, so the columns of
    :func:`edit_distance` are left as soon as it exceeds ``most``.
    """
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    distance = len(a) - len(b)
    if not b or distance > most:
        return distance <= most
    where: dict[str, int] = {}
    for i, sign in enumerate(a):
        where[sign] = where.get(sign, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for diagonal, sign in enumerate(b, distance):
        match = where.get(sign, 0) | down
        across = ((match & up) + up ^ up) | match
        if not across >> diagonal & 1:
            distance += 1
            if distance > most:
                return False
        rise = (down | ~(across | up) & full) << 1 & full | 1
        up, down = ((up & across) << 1 | ~(across | rise)) & full, rise & across
    return True


def similar(a: str, b: str, percent: int) -> bool:
    """Whether at most ``100 - percent`` percent of the longer line must be edited."""
    longest = max(len(a), len(b))
    allowed = (100 - percent) * longest
    return within(a, b, allowed // 100)


def _verified(batches, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(x, y, percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, lines: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the unique line pairs that are similar by edits."""
    wanted = pairs.sparkSession.sparkContext.broadcast(merged_sketch(pairs, _pair_hashes, 2, LOG_WANTED_CELLS))
    some = arrow_map(lines, partial(_marked, wanted=wanted), "cls bigint, line string")
    left = some.select(F.col("cls").alias("a"), F.col("line").alias("x"))
    right = some.select(F.col("cls").alias("b"), F.col("line").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    linked = scratch.written(arrow_map(joined, partial(_verified, percent=percent), "a bigint, b bigint"))
    wanted.destroy()
    return linked


def _rebuilt(batches, text: str) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        starts, ends, line_bounds = line_spans(data, bounds)
        gone = rows.column("gone").combine_chunks()
        per_text = pc.fill_null(pc.list_value_length(gone), 0).to_numpy().astype(np.int64)
        keep = np.ones(len(starts), dtype=bool)
        keep[np.repeat(line_bounds[:-1], per_text) + gone.flatten().to_numpy().astype(np.int64)] = False
        # A kept line with the line feed behind it, but for the last kept one.
        kept = np.flatnonzero(keep)
        text_of = owners(line_bounds)[kept]
        feed = np.ones(len(kept), dtype=np.int64)
        feed[np.flatnonzero(np.append(text_of[1:] != text_of[:-1], True))[: len(kept)]] = 0
        lengths = (ends - starts)[kept]
        to = np.cumsum(lengths + feed) - lengths - feed
        joined = np.full(int((lengths + feed).sum()), ord("\n"), dtype=np.uint8)
        joined[gather_ranges(to, lengths)] = data[gather_ranges(starts[kept], lengths)]
        sizes = np.bincount(text_of, weights=lengths + feed, minlength=len(rows)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        kept_text = pa.Array.from_buffers(
            pa.large_string(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(joined)]
        )
        out = rows.drop_columns([text, "gone"])
        out = out.append_column("n_lines", pa.array(np.diff(line_bounds), pa.int64()))
        out = out.append_column("n_removed", pa.array(per_text, pa.int64()))
        out = out.append_column("kept_text", kept_text.cast(pa.string()))
        yield from out.combine_chunks().to_batches()


def remove_fuzzy_lines(
    samples: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    min_words: int = MIN_WORDS,
    percent: int = EDIT_PERCENT,
    digits: bool = True,
) -> DataFrame:
    """Isolation texts with one occurrence of each group of similar lines.

    Returns ``key``, ``n_lines``, ``n_removed`` and ``kept_text``, and passes other
    columns of ``samples`` through (their names must not be these).

    Lines are split at line feeds and normalised: lower case, signs and white space
    as single blanks. Lines of fewer than ``min_words`` words are never removed. Lines
    equal after normalising are one class; digits are part of a line, unless ``digits`` is
    False. To find candidates, digits are folded to 0. Classes of ``FUZZY_WORDS`` words or more get a 64-bit
    SimHash of such words; candidates differ in at most ``DISTANCE`` bits, which shared
    block keys find without fail, or have half of their words in common and differ in
    at most ``HALF_DISTANCE`` bits. Shorter ones are candidates when they differ in one word
    or by one word, unless their letters show that they take more edits. Two candidates
    are linked when at most ``100 - percent`` percent of the longer
    line must be edited to get the other. Of each connected group the occurrence
    with the smallest key, then line number, stays; a null key comes last.

    Key buckets are dealt over the cluster; in each, lines are paired with a pivot
    first, then compared only with lines of other components, so a line of thousands
    of variants costs its rows rather than its pairs, and no link that changes a
    component is lost. A count-min sketch drops keys that one class alone has, and rows
    without a near one in their bucket, of a length that allows them to be similar, go
    before anything is paired. Lines that are compared are found again by a hash of their bytes.

    Rows equal in key and text are one document: all of them keep the same lines. A
    null text counts as an empty one, which is one empty line and stays as it is.
    """
    clash = {"n_lines", "n_removed", "kept_text", "_doc", "gone"} & set(samples.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    named = samples.withColumn("_doc", F.xxhash64(F.col(key).cast("string"), F.col(text)))
    kind = samples.schema[key].dataType.simpleString()
    lines = written(
        arrow_map(
            named.select(key, "_doc", text),
            partial(_lines, text=text, key=key, min_words=min_words, digits=digits),
            f"`{key}` {kind}, _doc bigint, line int, cls bigint, sim bigint, raw bigint, chars int, keys array<bigint>",
        )
    )
    texts = samples.select(text)
    scratch = Scratch(samples.sparkSession)
    classes = scratch.written(
        lines.filter("sim is not null").groupBy("cls").agg(
            F.min("sim").alias("sim"), F.min("raw").alias("raw"), F.min("chars").alias("chars"), F.first("keys").alias("keys")
        )
    )
    n_keys = classes.agg(F.sum(F.size("keys") + comb(BLOCKS, BLOCKS - DISTANCE)).alias("n")).first()["n"] or 0
    log_cells = min(max((CELLS_PER_KEY * n_keys).bit_length(), LEAST_LOG_KEY_CELLS), MOST_LOG_KEY_CELLS)
    shared = samples.sparkSession.sparkContext.broadcast(merged_sketch(classes, _key_hashes, 2, log_cells))
    rows = arrow_map(classes, partial(_key_rows, shared=shared), "token bigint, cls bigint, sim bigint, chars int")
    met = scratch.written(
        arrow_map(
            rows.repartition("token").sortWithinPartitions("token"),
            partial(_near_rows, percent=percent),
            "token bigint, cls bigint, sim bigint, chars int",
        )
    )
    shared.destroy()
    # One line of every class that has a near one, found again by its bytes.
    near = classes.join(met.select("cls").distinct(), "cls", "left_semi").select(F.col("raw").alias("cls"))
    wanted = samples.sparkSession.sparkContext.broadcast(merged_sketch(near, _class_hashes, 2, LOG_WANTED_CELLS))
    held = scratch.written(
        arrow_map(texts, partial(_wanted_lines, text=text, wanted=wanted, digits=digits), "cls bigint, line string")
        .groupBy("cls")
        .agg(F.min("line").alias("line"))
    )
    wanted.destroy()
    scratch.delete(classes)
    stars = arrow_map(
        met.repartition("token").sortWithinPartitions("token"), partial(_star_pairs, percent=percent), "a bigint, b bigint"
    ).distinct()
    found = scratch.written(components(_links(scratch.written(stars), held, percent, scratch)))
    labelled = met.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    # What is left: buckets whose lines lie in more than one component.
    open_ = (
        labelled.groupBy("token")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .filter("_low < _high")
        .select("token")
    )
    rest = arrow_map(
        labelled.join(open_, "token").join(held, "cls")
        .select("token", "cls", "sim", "component", "line")
        .repartition("token")
        .sortWithinPartitions("token"),
        partial(_rest_links, percent=percent),
        "a bigint, b bigint",
    )
    # Members of a component hang on its smallest one, which stands for their links.
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)
    of_class = written(components(links)).withColumnRenamed("node", "cls")
    scratch.clear()

    grouped = written(
        lines.select(key, "_doc", "line", "cls")
        .join(of_class, "cls", "left")
        .select(
            F.coalesce("component", "cls").alias("component"),
            F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "_doc", "line").alias("at"),
        )
    )
    stays = grouped.groupBy("component").agg(F.min("at").alias("_first"))
    gone = (
        grouped.join(stays, "component")
        .filter("at <> _first")
        .select(F.col("at._doc").alias("_doc"), F.col("at.line").alias("line"))
        .groupBy("_doc")
        .agg(F.array_sort(F.collect_set("line")).alias("gone"))
    )
    judged = named.join(gone, "_doc", "left").drop("_doc")
    others = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name != text
    )
    return arrow_map(
        judged.select(*[c for c in samples.columns], "gone"),
        partial(_rebuilt, text=text),
        f"{others}, n_lines bigint, n_removed bigint, kept_text string",
    )
