"""Grouped prefix join of texts on the Jaccard similarity of word n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.llm.kernels import (
    arrow_map, binary_column, carried, flat, gather_ranges, hashed_spans, mixed, owners, text_blocks, to_signed,
    window_hashes, word_spans,
)
from cultiva.llm.sketches import SEGMENT, RepeatedCells, added_hits, fetched, merged_sketch, segments
from cultiva.llm.tables import components, written
from cultiva.session import Scratch

NGRAM = 4
PERCENT = 85
LOG_BUCKETS = 18
# Cells for shingles of one text alone: about one for every eight bytes of text.
LEAST_LOG_SEEN = 20
MOST_LOG_SEEN = 30
BYTES_PER_CELL = 8
HELD_HASHES = 1 << 18
BLOCK_BYTES = 4 << 20
_SLAB = 1 << 12


class Rarity:
    """The global order of shingles: those of one text alone first, then by powers of two of a bucket's count."""

    def __init__(self, log_seen: int):
        self.seen = RepeatedCells(1, log_seen)
        self.counts = np.zeros(1 << LOG_BUCKETS, dtype=np.int64)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """0 for a shingle that no second text has, up to 127 for the most frequent ones."""
        rank = np.log2(self.counts + 1)[(h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64)] * 3 + 1
        rank = np.minimum(rank, 127).astype(np.uint64)
        rank[self.alone(h)] = 0
        return rank

    def alone(self, h: np.ndarray) -> np.ndarray:
        """Whether it is certain that no second text has a shingle."""
        found = _tracked(h)
        at = np.flatnonzero(found)
        found[at] = ~self.seen.repeated(h[at])
        return found


def _tracked(h: np.ndarray) -> np.ndarray:
    """Half of all shingles: as a prefix needs a fifth of them, enough are of one text alone."""
    return h & np.uint64(1) == 0


def shingle_sets(
    data: np.ndarray, bounds: np.ndarray, n: int, rarity: Rarity | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the distinct n-word shingles of every text, in order.

    A to Z are lower-cased. A text with fewer than ``n`` words has its whole
    sequence as the only shingle, one without words none. The order is the same for
    all texts: rare shingles first (by the ranks of ``rarity``), then by hash;
    without ``rarity`` by hash alone.
    """
    capital = (data >= 65) & (data <= 90)
    small = data + capital.astype(np.uint8) * np.uint8(32)
    starts, ends, word_bounds = word_spans(small, bounds)
    words = hashed_spans(small, starts, ends)
    n_words = np.diff(word_bounds)
    h, text = [], []
    for width in range(1, n + 1):
        if width < n:
            # Whole sequences of exactly this many words.
            chosen = np.flatnonzero(n_words == width)
            at = word_bounds[chosen]
            if len(at) == 0:
                continue
            windows = window_hashes(words, width)
        else:
            windows = window_hashes(words, n)
            owner = owners(word_bounds)
            at = np.flatnonzero(np.arange(len(windows)) + n <= word_bounds[1:][owner[: len(windows)]])
            chosen = owner[at]
        h.append(mixed(windows[at] + np.uint64(width)))
        text.append(chosen)
    h, text = np.concatenate(h), np.concatenate(text)
    # One sort key: text, rank, leading bits of the hash.
    bits = max(1, int(len(bounds)).bit_length())
    rank = np.uint64(0)
    if rarity is not None:
        rank = rarity.ranks(h) << np.uint64(57 - bits)
    key = text.astype(np.uint64) << np.uint64(64 - bits) | rank | h >> np.uint64(bits + 7)
    order = np.argsort(key)
    if ((np.diff(key[order]) == 0) & (np.diff(h[order]) != 0)).any():
        order = np.lexsort((h, key))  # leading bits of two shingles agree: decide by all
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(bounds)))


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that any partner of a set of this size must share with it."""
    return -(-percent * size // 100)


def _counted(batches, text: str, n: int, log_seen: int) -> Iterator[pa.RecordBatch]:
    """Cells hit by the shingles of this task's texts (row 0) and counts of buckets (row 1); equal sets once."""
    counts = np.zeros(1 << LOG_BUCKETS, dtype=np.int64)
    seen: set = set()
    held: list[np.ndarray] = []
    for _, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        h, bounds = shingle_sets(data, bounds, n)
        sizes = np.diff(bounds)
        fresh = _new(_wrapped_sums(mixed(h), bounds[:-1], sizes), np.flatnonzero(sizes > 0), seen)
        h = h[gather_ranges(bounds[:-1][fresh], sizes[fresh])]
        counts += np.bincount((h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64), minlength=len(counts))
        held.append(h[_tracked(h)])
        if sum(map(len, held)) > HELD_HASHES:
            yield from segments(np.concatenate(held), 1, log_seen)
            held = []
    if held:
        yield from segments(np.concatenate(held), 1, log_seen)
    slabs = counts.reshape(-1, _SLAB)
    yield pa.record_batch(
        {
            "row": pa.array(np.ones(len(slabs)), pa.int32()),
            "segment": pa.array(range(len(slabs)), pa.int32()),
            "once": pa.array([s.tobytes() for s in slabs], pa.binary()),
            "more": pa.array([b""] * len(slabs), pa.binary()),
        }
    )


def _added(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (row, segment) to a bitmap per segment and a sum per slab."""
    key, held = None, None

    def done():
        total = np.packbits(held >= 2) if key[0] == 0 else held
        return pa.record_batch(
            {
                "row": pa.array([key[0]], pa.int32()),
                "segment": pa.array([key[1]], pa.int32()),
                "total": pa.array([total.tobytes()], pa.binary()),
            }
        )

    for batch in batches:
        for row, segment, once, more in zip(*(batch.column(c).to_pylist() for c in ("row", "segment", "once", "more"))):
            if key != (row, segment):
                if key is not None:
                    yield done()
                key = (row, segment)
                held = np.zeros(_SLAB, dtype=np.int64) if row else np.zeros(SEGMENT, dtype=np.uint8)
            if row:
                held += np.frombuffer(once, dtype=np.int64)
            else:
                added_hits(held, once, more)
    if key is not None:
        yield done()


def rarity_of(texts: DataFrame, text: str, n: int) -> Rarity:
    """The order of shingles over all texts.

    How many texts hold a shingle of each of ``2 ** LOG_BUCKETS`` hash buckets, a
    fixed two megabytes, and a bit for every cell of shingles, with as many cells as
    the corpus calls for: few unrelated texts then share a token of their prefixes,
    however many texts there are. From ``2 ** MOST_LOG_SEEN`` cells on (128 MB) they
    fill up, and the order falls back on the buckets.
    """
    size = texts.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    log_seen = min(max((size // BYTES_PER_CELL).bit_length(), LEAST_LOG_SEEN), MOST_LOG_SEEN)
    parts = arrow_map(
        texts,
        partial(_counted, text=text, n=n, log_seen=log_seen),
        "row int, segment int, once binary, more binary",
    )
    merged = arrow_map(
        parts.repartition("row", "segment").sortWithinPartitions("row", "segment"),
        _added,
        "row int, segment int, total binary",
    )
    rarity = Rarity(log_seen)
    for found in fetched(merged):
        if found["row"]:
            at = found["segment"] * _SLAB
            rarity.counts[at : at + _SLAB] = np.frombuffer(found["total"], dtype=np.int64)
        else:
            rarity.seen.put(0, found["segment"], bytes(found["total"]))
    return rarity


_BITS = 1024


class _Sets:
    """Ordered shingle sets of a block, with what the join needs of them."""

    def __init__(self, data, bounds, n: int, percent: int, rarity: Rarity):
        self.h, self.bounds = shingle_sets(data, bounds, n, rarity)
        self.sizes = np.diff(self.bounds)
        self.prefix = np.where(self.sizes > 0, self.sizes - least_overlap(self.sizes, percent) + 1, 0)
        place = np.arange(len(self.h)) - self.bounds[:-1][owners(self.bounds)]
        weight = mixed(self.h + np.uint64(0x9E3779B97F4A7C15) * (place + 1).astype(np.uint64))
        self.cls = mixed(_wrapped_sums(weight, self.bounds[:-1], self.sizes) + self.sizes.astype(np.uint64))
        self.grp = mixed(
            _wrapped_sums(weight, self.bounds[:-1], self.prefix) * np.uint64(3) + self.sizes.astype(np.uint64)
        )

    def bitmaps(self) -> np.ndarray:
        words = np.zeros((len(self.sizes), _BITS), dtype=bool)
        words[owners(self.bounds), ((self.h >> np.uint64(20)) & np.uint64(_BITS - 1)).astype(np.int64)] = True
        return np.packbits(words, axis=1)


def _wrapped_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[starts + lengths] - total[starts]


def _self_token(grp: np.ndarray) -> np.ndarray:
    """The bucket in which the members of a group meet each other."""
    return mixed(grp ^ np.uint64(0x5851F42D4C957F2D))


def _blocks(batches, text, n, percent, rarity):
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        yield rows, _Sets(data, bounds, n, percent, rarity)


def _new(values: np.ndarray, use: np.ndarray, seen: set) -> np.ndarray:
    """First places, among ``use``, of values not in ``seen``; adds them to it."""
    fresh, first = np.unique(values[use], return_index=True)
    known = np.fromiter((int(v) in seen for v in fresh), dtype=bool, count=len(fresh))
    seen.update(int(v) for v in fresh[~known])
    return use[first[~known]]


def _members(batches, text, n, percent, rarity, drop) -> Iterator[pa.RecordBatch]:
    """One row per text; the first of a class here has a bitmap, of a group its prefix.

    The shingles that no second text has lead every prefix and meet nobody: they are left out.
    """
    groups: set = set()
    classes: set = set()
    for rows, sets in _blocks(batches, text, n, percent, rarity.value):
        some = np.flatnonzero(sets.sizes > 0)
        first = _new(sets.cls, some, classes)
        lead = _new(sets.grp, some, groups)
        lengths = np.zeros(len(rows), dtype=np.int64)
        lengths[lead] = sets.prefix[lead]
        tokens = sets.h[gather_ranges(sets.bounds[:-1], lengths)]
        meets = ~rarity.value.alone(tokens)
        tokens, lengths = tokens[meets], np.bincount(np.repeat(np.arange(len(rows)), lengths)[meets], minlength=len(rows))
        empty = sets.sizes == 0
        in_use = np.zeros(len(rows), dtype=bool)
        in_use[first] = True
        bitmaps = sets.bitmaps()
        out = rows.drop_columns(drop)
        out = out.append_column("n_shingles", pa.array(sets.sizes, pa.int64()))
        out = out.append_column("cls", pa.array(to_signed(sets.cls), pa.int64(), mask=empty))
        out = out.append_column("grp", pa.array(to_signed(sets.grp), pa.int64(), mask=empty))
        out = out.append_column(
            "prefix", binary_column(tokens.view(np.uint8), np.concatenate([[0], np.cumsum(lengths)]) * 8)
        )
        out = out.append_column(
            "bitmap", pa.array([b.tobytes() if u else None for b, u in zip(bitmaps, in_use)], pa.binary())
        )
        yield from out.combine_chunks().to_batches()


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of a batch of members, and how many each has."""
    lengths = pc.binary_length(batch.column("prefix")).to_numpy().astype(np.int64) // 8
    return np.frombuffer(flat(batch.column("prefix")).tobytes(), dtype=np.uint64), lengths


def _prefix_hashes(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        yield _prefixes(batch)[0]
        # The first of a class meets its group in a bucket of the group's own.
        own = batch.filter(pc.is_valid(batch.column("bitmap"))).column("grp")
        yield _self_token(own.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _bucket_rows(batches, shared, percent: int) -> Iterator[pa.RecordBatch]:
    """``(token, cls, grp, size, place)`` of tokens that more than one group seems to have.

    Place -1 marks the bucket of the group itself.
    """
    for batch in batches:
        tokens, lengths = _prefixes(batch)
        keep = np.flatnonzero(shared.value.repeated(tokens))
        owner = np.repeat(np.arange(len(lengths)), lengths)[keep]
        # What is left of a prefix is its end.
        size = batch.column("n_shingles").to_numpy()
        place = gather_ranges(size - least_overlap(size, percent) + 1 - lengths, lengths)[keep]
        first = np.flatnonzero(pc.is_valid(batch.column("bitmap")).to_numpy(zero_copy_only=False))
        grp = pc.fill_null(batch.column("grp"), 0).to_numpy().view(np.uint64)
        alone = _self_token(grp[first])
        meets = shared.value.repeated(alone)
        owner = np.concatenate([owner, first[meets]])
        taken = pa.array(owner)
        yield pa.record_batch(
            {
                "token": pa.array(to_signed(np.concatenate([tokens[keep], alone[meets]]))),
                "cls": batch.column("cls").take(taken),
                "grp": batch.column("grp").take(taken),
                "size": batch.column("n_shingles").take(taken),
                "place": pa.array(np.concatenate([place, np.full(int(meets.sum()), -1)]), pa.int32()),
            }
        )


def _bucket_runs(batches, columns, of=None) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole buckets, as arrays of ``columns``, from batches sorted by token.

    ``of`` turns batches of whole buckets into what is yielded; by default into one
    item per bucket of two rows or more.
    """
    of = of or _runs_of
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        tokens = batch.column("token").to_numpy()
        last = int(np.searchsorted(tokens == tokens[-1], True)) if len(tokens) else 0
        if waiting and len(tokens) and waiting[-1].column("token")[-1].as_py() == tokens[-1]:
            waiting.append(batch)  # one token through and through: it may go on
            continue
        if len(tokens) == 0:
            continue
        waiting.append(batch.slice(0, last))
        yield from of(waiting, columns)
        waiting = [batch.slice(last)]
    if waiting:
        yield from of(waiting, columns)


def _whole(batches, columns):
    """``(arrays, cuts)`` of whole buckets side by side."""
    table = pa.Table.from_batches(batches).combine_chunks()
    if len(table) == 0:
        return None
    tokens = table.column("token").to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
    return [table.column(c).to_numpy() for c in columns], cuts


def _runs_of(batches, columns):
    whole = _whole(batches, columns)
    if whole is not None:
        arrays, cuts = whole
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield tuple(x[a:b] for x in arrays)


def _may_link(size_a, place_a, size_b, place_b, percent: int) -> np.ndarray:
    """Length and position filter for a shared token at these places."""
    need = -(-percent * (size_a + size_b) // (100 + percent))
    room = np.minimum(size_a - np.maximum(place_a, 0), size_b - np.maximum(place_b, 0))
    return room >= need


def _stars(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of every class of a bucket with a pivot of it: linear in its rows."""
    columns = ("cls", "size", "place")
    for whole in _bucket_runs(batches, columns, lambda held, names: [_whole(held, names)]):
        if whole is None:
            continue
        (cls, size, place), cuts = whole
        order = mixed(cls.view(np.uint64))
        least = np.repeat(np.minimum.reduceat(order, cuts[:-1]), np.diff(cuts))
        # Equal classes have equal hashes, so the first of them stands for all.
        chosen = np.flatnonzero(order == least)
        bucket = np.searchsorted(cuts, chosen, "right") - 1
        pivot = np.repeat(chosen[np.unique(bucket, return_index=True)[1]], np.diff(cuts))
        ok = (cls != cls[pivot]) & _may_link(size, place, size[pivot], place[pivot], percent)
        a, b = cls[ok], cls[pivot[ok]]
        pair = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        yield pa.record_batch({"a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])})


def _bound(bits, size, i, percent) -> tuple[np.ndarray, np.ndarray]:
    """``(most shared shingles, least needed)`` of one set with others, by bitmaps."""
    differ = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
    both = size + size[i]
    return (both - differ) // 2, -(-percent * both // (100 + percent))


def _rest(batches, percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket that lie in different components and may still link.

    With ``nearest`` only the most promising partner of each class, else all.
    """
    a, b = [], []
    for cls, size, place, component, raw in _bucket_runs(batches, ("cls", "size", "place", "component", "bitmap")):
        names, number, n = np.unique(component, return_inverse=True, return_counts=True)
        if len(names) == 1:
            continue
        cls, first = np.unique(cls, return_index=True)
        size, place, number = size[first], place[first], number[first]
        bits = np.frombuffer(b"".join(raw[first]), dtype=np.uint64).reshape(len(first), -1)
        # Who is not in the largest component is held against everybody.
        for i in np.flatnonzero(number != n.argmax()):
            most, need = _bound(bits, size, i, percent)
            ok = (number != number[i]) & _may_link(size, place, size[i], place[i], percent) & (most >= need)
            ok = np.flatnonzero(ok)
            if nearest and len(ok):
                ok = ok[[np.argmax(most[ok] - need[ok])]]
            a.append(np.minimum(cls[ok], cls[i]))
            b.append(np.maximum(cls[ok], cls[i]))
        if len(a) > 4096:
            yield _pairs(a, b)
            a, b = [], []
    if a:
        yield _pairs(a, b)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    pair = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
    return pa.record_batch({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})


def _promising(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both bitmaps: those that may link, and by how much."""
    for batch in batches:
        x, y = (
            np.frombuffer(flat(batch.column(c)).tobytes(), dtype=np.uint64).reshape(len(batch), -1)
            for c in ("x", "y")
        )
        both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
        most = (both - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)) // 2
        spare = most - -(-percent * both // (100 + percent))
        out = batch.select(["a", "b"]).append_column("spare", pa.array(spare, pa.int64()))
        yield out.filter(pa.array(spare >= 0))


def _class_hashes(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        # Twice each, so that the sketch marks every one of them.
        yield np.repeat(batch.column("cls").to_numpy().view(np.uint64), 2)


def _marked(batches, wanted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(wanted.value.repeated(batch.column("cls").to_numpy().view(np.uint64))))


def _pair_hashes(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for side in ("a", "b"):
            # Twice each, so that the sketch marks every one of them.
            yield np.repeat(batch.column(side).to_numpy().view(np.uint64), 2)


def _wanted_sets(batches, text, n, percent, rarity, wanted) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for _, sets in _blocks(batches, text, n, percent, rarity.value):
        some = np.flatnonzero(sets.sizes > 0)
        some = _new(sets.cls, some[wanted.value.repeated(sets.cls[some])], seen)
        lengths = sets.sizes[some]
        tokens = sets.h[gather_ranges(sets.bounds[:-1][some], lengths)]
        yield pa.record_batch(
            {
                "cls": pa.array(to_signed(sets.cls[some])),
                "tokens": binary_column(
                    # Six bytes tell the shingles of two texts apart.
                    np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).ravel(),
                    np.concatenate([[0], np.cumsum(lengths)]) * 6,
                ),
            }
        )


def _six(value) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), dtype=np.uint8).reshape(-1, 6)
    whole = np.zeros((len(raw), 8), dtype=np.uint8)
    whole[:, :6] = raw
    return whole.view(np.uint64).ravel()


def _verified(batches, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = _six(x), _six(y)
            both = np.sort(np.concatenate([x, y]))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Join:
    """The steps of the join over one table of texts."""

    def __init__(self, texts: DataFrame, text: str, n: int, percent: int):
        self.texts, self.text, self.percent = texts, text, percent
        context = texts.sparkSession.sparkContext
        self.context = context
        self.scratch = Scratch(texts.sparkSession)
        self.rarity = context.broadcast(rarity_of(texts, text, n))
        self.common = {"text": text, "n": n, "percent": percent, "rarity": self.rarity}

    def keep_sets(self, classes: DataFrame) -> None:
        """Write the whole sets of ``classes``, a table of unique ``cls``."""
        wanted = self.context.broadcast(merged_sketch(classes, _class_hashes, 2, LOG_WANTED_CELLS))
        self.sets = self.scratch.written(
            arrow_map(self.texts, partial(_wanted_sets, wanted=wanted, **self.common), "cls bigint, tokens binary")
            .groupBy("cls")
            .agg(F.min("tokens").alias("tokens"))
        )
        wanted.destroy()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the unique class pairs that link, by their whole sets."""
        wanted = self.context.broadcast(merged_sketch(pairs, _pair_hashes, 2, LOG_WANTED_CELLS))
        sets = arrow_map(self.sets, partial(_marked, wanted=wanted), "cls bigint, tokens binary")
        left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
        right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
        linked = self.scratch.written(
            arrow_map(
                pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"),
                partial(_verified, percent=self.percent),
                "a bigint, b bigint",
            )
        )
        wanted.destroy()
        return linked


# Cells of the sketch for every prefix token, within bounds: the share of false alarms stays.
CELLS_PER_TOKEN = 8
LEAST_LOG_TOKEN_CELLS = 20
MOST_LOG_TOKEN_CELLS = 29
LOG_WANTED_CELLS = 24


def jaccard_components(
    samples: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    ngram: int = NGRAM,
    percent: int = PERCENT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(key, n_shingles, component_id, cluster)``: groups of similar isolation texts.

    The set of a text are its distinct word ``ngram``s, A to Z lower-cased; with
    fewer words, the whole sequence. Two texts link when the shared shingles are at
    least ``percent`` of the union of both sets. ``component_id`` is the smallest
    ``key`` reachable over links, itself included; ``cluster`` numbers the group and is
    null for a text without shingles.

    Texts with equal sets are one class. Shingles are put in one global order, those
    of one text alone first, then rare hash buckets, and classes with the same prefix and size form a group; by
    the prefix principle only groups that share a prefix token can link. Shingles of one
    text alone are left out of the prefixes, and a count-min sketch that grows with what is
    left of them drops tokens that one group alone has. In the bucket of
    a token, groups that pass the length and position filters are expanded to their
    members. Each is paired with a pivot of the bucket, the most promising pair of
    each is verified on whole sets, and components grow. Only pairs across
    components are of interest then: first the nearest one of each member, last all
    of them. A bitmap of each set bounds the shared shingles from above, so that what
    cannot link is not verified. A pair inside one component can change nothing, so
    the components are exact, and a group of thousands of near copies costs its rows
    rather than its pairs.

    Texts without words, empty or null, have no shingles and link with nothing. A
    null key is nobody's smallest key: a component of null keys alone has a null id.
    Repeated rows are texts of their own. Columns named in ``carry`` come back as they
    are (their names must not be those above), the others are ignored.
    """
    chosen, fields, drop = carried(samples, key, text, carry)
    join = _Join(chosen.select(text), text, ngram, percent)
    scratch = join.scratch
    members = written(
        arrow_map(
            chosen,
            partial(_members, drop=drop, **join.common),
            f"{fields}, n_shingles bigint, cls bigint, grp bigint, prefix binary, bitmap binary",
        )
    )
    heads = members.filter("bitmap is not null or length(prefix) > 0")
    n_tokens = heads.agg(F.sum(F.length("prefix") / 8 + 1).cast("bigint").alias("n")).first()["n"] or 0
    log_cells = min(max((CELLS_PER_TOKEN * n_tokens).bit_length(), LEAST_LOG_TOKEN_CELLS), MOST_LOG_TOKEN_CELLS)
    shared = join.context.broadcast(
        merged_sketch(heads.select("prefix", "bitmap", "grp"), _prefix_hashes, 2, log_cells)
    )
    rows = scratch.written(
        arrow_map(
            heads.select("cls", "grp", "n_shingles", "prefix", "bitmap"),
            partial(_bucket_rows, shared=shared, percent=percent),
            "token bigint, cls bigint, grp bigint, size bigint, place int",
        )
    )
    shared.destroy()
    known = scratch.written(
        heads.filter("bitmap is not null")
        .groupBy("cls")
        .agg(F.min("grp").alias("grp"), F.min("n_shingles").alias("size"), F.min("bitmap").alias("bitmap"))
    )
    # Groups of the buckets, expanded to all their classes; buckets of one class go.
    expanded = rows.select("token", "grp", "place").distinct().join(known.select("cls", "grp", "size"), "grp")
    met = scratch.written(
        expanded.join(
            expanded.groupBy("token").agg(F.min("cls").alias("_low"), F.max("cls").alias("_high")).filter(
                "_low < _high"
            ).select("token"),
            "token",
        )
    )
    scratch.delete(rows)
    join.keep_sets(met.select("cls").distinct())

    stars = arrow_map(
        met.select("token", "cls", "size", "place").repartition("token").sortWithinPartitions("token"),
        partial(_stars, percent=percent),
        "a bigint, b bigint",
    ).distinct()
    bitmaps = known.select("cls", "size", "bitmap")
    left = bitmaps.select(F.col("cls").alias("a"), F.col("size").alias("size_a"), F.col("bitmap").alias("x"))
    right = bitmaps.select(F.col("cls").alias("b"), F.col("size").alias("size_b"), F.col("bitmap").alias("y"))
    promising = scratch.written(
        arrow_map(
            stars.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "x", "y"),
            partial(_promising, percent=percent),
            "a bigint, b bigint, spare bigint",
        )
    )
    # The most promising pivot of every class is verified first.
    ends = promising.select(F.col("a").alias("cls"), "a", "b", "spare").unionByName(
        promising.select(F.col("b").alias("cls"), "a", "b", "spare")
    )
    best = ends.groupBy("cls").agg(F.max(F.struct("spare", "a", "b")).alias("_p")).select("_p.a", "_p.b")
    tried = scratch.written(best.distinct())
    scratch.delete(promising)
    grown = scratch.written(components(join.verified(tried)))
    for nearest in (True, False):
        # What is left: buckets whose classes lie in more than one component.
        found = grown.withColumnRenamed("node", "cls")
        labelled = met.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        open_ = (
            labelled.groupBy("token")
            .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
            .filter("_low < _high")
            .select("token")
        )
        rest = arrow_map(
            labelled.join(open_, "token")
            .join(known.select("cls", "bitmap"), "cls")
            .select("token", "cls", "size", "place", "component", "bitmap")
            .repartition("token")
            .sortWithinPartitions("token"),
            partial(_rest, percent=percent, nearest=nearest),
            "a bigint, b bigint",
        ).distinct()
        fresh = scratch.written(rest.join(tried, ["a", "b"], "left_anti"))
        # Members of a component hang on its smallest one, which stands for their links.
        stars = grown.select(F.col("node").alias("a"), F.col("component").alias("b"))
        old, grown = grown, scratch.written(components(stars.unionByName(join.verified(fresh))))
        scratch.delete(old)
        tried = tried.unionByName(fresh)
    of_class = written(grown).withColumnRenamed("node", "cls")
    join.rarity.destroy()
    scratch.clear()
    kept = [key, *[c for c in carry if c != key]]
    named = members.select(*kept, "n_shingles", "cls").join(of_class, "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    smallest = (
        named.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(key).alias("component_id"))
    )
    return named.join(smallest, "component", "left").select(
        *kept,
        "n_shingles",
        F.when(F.col("component").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
        F.col("component").alias("cluster"),
    )
