"""Boosted trees for many models at once, grown from shared histograms.

All models of a run (media times folds, classes times folds, targets) share one
table of binned features. A job grows one level of the next tree of *every*
model: tasks add up gradients by model, node, feature and bin, the sums are
shuffled by model and node, and each reducer picks the best split. So the number
of jobs is rounds times depth, whatever the number of models, and only one row
per model and node reaches the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva.session import Scratch

MISSING = 0  # bin of a missing feature; values have bins from 1
ROWS = 1 << 15  # rows whose gradients are added up at once
HELD = 64 << 20  # bytes of sums a task holds before it hands them on by chunk
WRITE_EVERY = 4  # rounds after which the scores so far are written out
LEAST_GAIN = 1e-9
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@dataclass(frozen=True)
class Trees:
    """Size and regularization of the boosted trees."""

    iterations: int = 300
    depth: int = 5
    step: float = 0.05
    bins: int = 64
    l2: float = 1.0
    min_weight: float = 1.0

    def __post_init__(self):
        if not (self.iterations > 0 and 0 < self.depth <= 12 and 2 <= self.bins <= 254):
            raise ValueError("a model has a round and a level at least, at most 12 levels and 254 bins")


@dataclass(frozen=True)
class Model:
    """One boosted sum of trees.

    ``label`` is the place of its label among the labels of the run, ``held_out`` the
    fold it does not train on (-1: none), ``fold`` the place of the fold column that
    counts for it. ``kind`` is ``squared`` (a number), ``binary`` (0 or 1, positives
    weighted by ``weight``) or ``softmax`` (class ``of_class`` of the models that share
    ``chain``). ``base`` is the score before the first tree.
    """

    name: str
    label: int
    kind: str
    chain: int
    held_out: int = -1
    fold: int = 0
    of_class: int = 0
    weight: float = 1.0
    base: float = 0.0


@dataclass
class Ensemble:
    """Fitted trees: complete binary trees in arrays ``[model, round, node]``."""

    features: list[str]
    cuts: list[np.ndarray]
    models: list[Model]
    depth: int
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    leaf: np.ndarray

    def importances(self, model: int) -> np.ndarray:
        """Share of the gain of each feature."""
        total = np.zeros(len(self.features))
        np.add.at(total, self.feature[model].ravel(), self.gain[model].ravel())
        return total / total.sum() if total.sum() > 0 else total

    def picked(self, models: Sequence[int]) -> Ensemble:
        """The same trees of some of the models only."""
        at = list(models)
        return Ensemble(
            self.features, self.cuts, [self.models[i] for i in at], self.depth,
            self.feature[at], self.bin[at], self.missing_left[at], self.gain[at], self.leaf[at],
        )


@dataclass
class Fit:
    """An ensemble, and the table it was fitted on with the scores of all its models."""

    ensemble: Ensemble
    rows: DataFrame
    scratch: Scratch = field(repr=False)

    def held_out(self, keep: Sequence[str]) -> DataFrame:
        """``(keep, chain, fold, scores)`` of every row by the models that did not train on its fold.

        ``scores`` has the value, the probability of 1, or one probability per class.
        """
        fields = _fields(self.rows, keep)
        work = partial(_held_out, models=self.ensemble.models, keep=list(keep))
        return _mapped(self.rows, work, f"{fields}, chain int, fold int, scores array<double>")


# --- preparation --------------------------------------------------------------


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of the bins of every feature, from one pass of mergeable sketches."""
    shares = [i / bins for i in range(1, bins)]
    known = [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)) for f in features]
    row = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"c{i}") for i, c in enumerate(known)]).first()
    return [np.unique(np.array(c if c is not None else [], dtype=np.float64)) for c in row]


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package, wherever the driver was started."""
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return df.mapInArrow(work, schema)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _vectors(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x")


def _entries(column: pa.Array, kind) -> np.ndarray:
    """A list column whose rows all have as many entries; nulls become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _raw(column: pa.Array, width: int, kind) -> np.ndarray:
    """A binary column whose rows all hold ``width`` numbers."""
    if len(column) == 0 or width == 0:
        return np.zeros((len(column), width), dtype=kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), width)


def _numbers(column: pa.Array, kind) -> np.ndarray:
    """A binary column of :func:`_binary`; its rows all hold as many numbers."""
    width = len(column[0].as_buffer()) // np.dtype(kind).itemsize if len(column) else 0
    return _raw(column, width, kind)


def _binary(values: np.ndarray) -> pa.Array:
    rows, size = len(values), values.shape[1] * values.itemsize
    offsets = np.arange(rows + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of values: 1 up to the first cut, and so on; NaN is ``MISSING``."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i, bounds in enumerate(cuts):
        out[:, i] = np.searchsorted(bounds, x[:, i], side="left") + 1
    out[np.isnan(x)] = MISSING
    return out


def _prepared(batches, cuts, base: np.ndarray, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _entries(batch.column("_x"), np.float64)
        scores = np.tile(base.astype(np.float32), (len(x), 1))
        yield pa.record_batch(
            {
                **{n: batch.column(n) for n in keep},
                "_labels": _binary(_entries(batch.column("_labels"), np.float64)),
                "_folds": _binary(_entries(batch.column("_folds"), np.int64)),
                "_bins": _binary(binned(x, cuts)),
                "_scores": _binary(scores),
            }
        )


# --- trees inside a task ------------------------------------------------------


def _routed(bins: np.ndarray, feature, bin_, missing_left, depth: int) -> np.ndarray:
    """Node of every row and model after ``depth`` levels of one tree per model.

    One model at a time, so that what a level needs stays in the cache; a node's
    decision is looked up by the bin.
    """
    n = len(bins)
    flat, place, values = np.ascontiguousarray(bins.T).ravel(), np.arange(n), np.arange(256)
    found = np.zeros((len(feature), n), dtype=np.int64)
    for i in range(len(feature)):
        node = found[i]
        for level in range(depth):
            at = slice((1 << level) - 1, (2 << level) - 1)
            right = values > bin_[i, at, None]
            right[:, MISSING] = ~missing_left[i, at]
            start = feature[i, at].astype(np.int64) * n
            value = flat[start[node] + place] if level else flat[start[0] : start[0] + n]
            node = 2 * node + right.ravel()[256 * node + value]
        found[i] = node
    return found.T


def added_scores(bins: np.ndarray, trees: Ensemble, scores: np.ndarray) -> np.ndarray:
    """Scores after all trees of ``trees``."""
    total = np.array(scores.T, order="C")
    for i in range(trees.feature.shape[1]):
        leaf = _routed(bins, trees.feature[:, i], trees.bin[:, i], trees.missing_left[:, i], trees.depth).T
        for j in range(len(trees.models)):
            total[j] += trees.leaf[j, i][leaf[j]]
    return total.T


def probabilities(scores: np.ndarray, models: Sequence[Model]) -> np.ndarray:
    """Scores as numbers, probabilities of 1, or class probabilities."""
    out = scores.astype(np.float64)
    chains: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        if m.kind == "binary":
            out[:, i] = 1 / (1 + np.exp(-np.clip(out[:, i], -500, 500)))
        elif m.kind == "softmax":
            chains.setdefault(m.chain, []).append(i)
    for at in chains.values():
        part = out[:, at]
        part = np.exp(part - part.max(axis=1, keepdims=True))
        out[:, at] = part / part.sum(axis=1, keepdims=True)
    return out


def _gradients(scores, labels, folds, models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives of every row and model, and which rows train."""
    p = probabilities(scores, models)
    g, h = np.zeros_like(p), np.zeros_like(p)
    trains = np.zeros(p.shape, dtype=bool, order="F")
    for i, m in enumerate(models):
        y = labels[:, m.label]
        trains[:, i] = ~np.isnan(y) & (folds[:, m.fold] != m.held_out)
        if m.kind == "squared":
            g[:, i], h[:, i] = p[:, i] - y, 1.0
        elif m.kind == "binary":
            w = np.where(y == 1, m.weight, 1.0)
            g[:, i], h[:, i] = w * (p[:, i] - y), w * p[:, i] * (1 - p[:, i])
        else:
            g[:, i], h[:, i] = p[:, i] - (y == m.of_class), 2 * p[:, i] * (1 - p[:, i])
    return g, h, trains


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= ROWS:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, size = [], 0
    if size:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _state(table: pa.Table, pending: Ensemble):
    def column(name):
        return table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)

    n_models = len(pending.models)
    bins = _raw(column("_bins"), len(pending.cuts), np.uint8)
    scores = added_scores(bins, pending, _raw(column("_scores"), n_models, np.float32))
    return bins, scores, _numbers(column("_labels"), np.float64), _numbers(column("_folds"), np.int64)


def _histograms(batches, pending: Ensemble, growing: tuple, level: int, width: int) -> Iterator[pa.RecordBatch]:
    """Sums of gradients by model, node, feature and bin; a row per model and node.

    A task adds up all its rows, unless the sums of all models outgrow :data:`HELD`.
    """
    nodes, n_features = 1 << level, len(pending.cuts)
    size = nodes * width
    together = len(pending.models) * size * n_features * 16 <= HELD
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for table in _chunks(batches):
        bins, scores, labels, folds = _state(table, pending)
        g, h, trains = _gradients(scores, labels, folds, pending.models)
        node = _routed(bins, *growing, level)
        columns = np.ascontiguousarray(bins.T)
        for i, model in enumerate(pending.models):
            rows = np.flatnonzero(trains[:, i])
            if len(rows) == 0:
                continue
            if i not in held:
                held[i] = np.zeros(nodes, dtype=np.int64), np.zeros((nodes, n_features, width, 2))
            counts, sums = held[i]
            at, first = node[rows, i], g[rows, i]
            # The second derivative of a squared error is 1.
            second = None if model.kind == "squared" else h[rows, i]
            counts += np.bincount(at, minlength=nodes)
            at = at * width
            for f in range(n_features):
                cell = at + columns[f][rows]
                sums[:, f, :, 0] += np.bincount(cell, first, size).reshape(nodes, width)
                sums[:, f, :, 1] += np.bincount(cell, second, size).reshape(nodes, width)
            if not together:
                yield _sums(i, *held.pop(i))
    for i, (counts, sums) in held.items():
        yield _sums(i, counts, sums)


def _sums(model: int, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(counts)
    return pa.record_batch(
        {
            "model": pa.array(np.full(len(used), model), pa.int32()),
            "node": pa.array(used, pa.int32()),
            "sums": _binary(sums[used].reshape(len(used), -1)),
        }
    )


SPLIT = (
    "model int, node int, feature int, bin int, missing_left boolean, gain double, "
    "gl double, hl double, gr double, hr double"
)


def _best_splits(batches, n_features: int, width: int, l2: float, min_weight: float) -> Iterator[pa.RecordBatch]:
    """Best split of every model and node; the rows of one follow each other."""
    key, total, found = None, None, []
    for batch in batches:
        sums = _raw(batch.column("sums"), n_features * width * 2, np.float64)
        for model, node, row in zip(batch.column("model").to_pylist(), batch.column("node").to_pylist(), sums):
            if key == (model, node):
                total += row
            else:
                if key is not None:
                    found.append((*key, *best_split(total.reshape(n_features, width, 2), l2, min_weight)))
                key, total = (model, node), row.copy()
    if key is not None:
        found.append((*key, *best_split(total.reshape(n_features, width, 2), l2, min_weight)))
    if found:
        names = [c.split()[0] for c in SPLIT.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.float64()] * 5
        yield pa.record_batch({n: pa.array(v, k) for n, v, k in zip(names, zip(*found), kinds)})


def best_split(sums: np.ndarray, l2: float, min_weight: float) -> tuple:
    """``(feature, bin, missing_left, gain, gl, hl, gr, hr)``; rows up to ``bin`` go left.

    ``sums`` holds first and second derivatives by feature and bin. Missing values
    are tried on either side, also against all present values. Without a gain all rows go left.
    """
    total = sums[0].sum(axis=0)
    up_to = np.cumsum(sums[:, 1:], axis=1)
    # [side of the missing, feature, bin, derivative]
    left = np.stack([up_to + sums[:, :1], up_to])
    right = total - left

    def part(s):
        return s[..., 0] ** 2 / (s[..., 1] + l2)

    gain = part(left) + part(right) - total[0] ** 2 / (total[1] + l2)
    gain[(left[..., 1] < min_weight) | (right[..., 1] < min_weight)] = -np.inf
    side, feature, bin_ = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[side, feature, bin_] <= LEAST_GAIN:
        return 0, sums.shape[1], True, 0.0, float(total[0]), float(total[1]), 0.0, 0.0
    (gl, hl), (gr, hr) = left[side, feature, bin_], right[side, feature, bin_]
    return (
        int(feature), int(bin_) + 1, bool(side == 0), float(gain[side, feature, bin_]),
        float(gl), float(hl), float(gr), float(hr),
    )


def _advanced(batches, pending: Ensemble, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The table with the pending trees added to its scores."""
    for table in _chunks(batches):
        _, scores, _, _ = _state(table, pending)
        columns = {n: table.column(n).combine_chunks() for n in keep}
        yield from pa.table({**columns, "_scores": _binary(scores.astype(np.float32))}).to_batches()


def _held_out(batches, models: list[Model], keep: list[str]) -> Iterator[pa.RecordBatch]:
    chains: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        chains.setdefault(m.chain, []).append(i)
    for batch in batches:
        p = probabilities(_raw(batch.column("_scores"), len(models), np.float32), models)
        folds = _numbers(batch.column("_folds"), np.int64)
        for chain, at in chains.items():
            first = models[at[0]]
            rows = np.flatnonzero((folds[:, first.fold] == first.held_out) & (first.held_out >= 0))
            if len(rows) == 0:
                continue
            out = batch.select(keep).take(pa.array(rows))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1) * len(at), pa.int32()), pa.array(p[rows][:, at].ravel())
            )
            columns = [
                pa.array(np.full(len(rows), chain), pa.int32()),
                pa.array(np.full(len(rows), first.held_out), pa.int32()),
                lists,
            ]
            yield pa.record_batch([*out.columns, *columns], names=[*keep, "chain", "fold", "scores"])


# --- driver -------------------------------------------------------------------


def fit(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[Column],
    models: Sequence[Model],
    trees: Trees = Trees(),
    folds: Sequence[Column] = (),
    keep: Sequence[str] = (),
) -> Fit:
    """Fit all ``models`` on the rows of ``df`` together.

    ``labels`` are the training labels (a row without one does not train the models of
    that label), ``folds`` the fold columns. Features may be missing: every split learns
    the side for it. The columns ``keep`` stay beside the scores for
    :meth:`Fit.held_out`. The state of a run is a table of bins and scores, written
    every :data:`WRITE_EVERY` rounds; a lost executor costs tasks of one level.
    """
    if not models or not features:
        raise ValueError("at least one model and one feature")
    spark = df.sparkSession
    scratch = Scratch(spark)
    cuts = quantile_cuts(df, features, trees.bins)
    width, n_models, n_nodes = trees.bins + 1, len(models), (1 << trees.depth) - 1
    models = list(models)
    numbers = F.array(*[c.cast("double") for c in labels]).alias("_labels")
    places = F.array(*[F.coalesce(c.cast("bigint"), F.lit(-2)) for c in folds or [F.lit(-2)]]).alias("_folds")
    source = df.select(*[f"`{n}`" for n in keep], numbers, places, _vectors(features))
    cores = spark.sparkContext.defaultParallelism
    numeric = "_labels binary, _folds binary, _bins binary, _scores binary"
    fields = f"{_fields(source, keep)}, {numeric}" if keep else numeric
    base = np.array([m.base for m in models])
    start = _mapped(source.repartition(cores), partial(_prepared, cuts=cuts, base=base, keep=list(keep)), fields)
    rows = scratch.written(start)

    def empty(rounds: int) -> Ensemble:
        shape = (n_models, rounds, n_nodes)
        return Ensemble(
            list(features), cuts, models, trees.depth, np.zeros(shape, dtype=np.int32),
            np.full(shape, width, dtype=np.int16), np.ones(shape, dtype=bool), np.zeros(shape),
            np.zeros((n_models, rounds, n_nodes + 1), dtype=np.float32),
        )

    grown, pending = [], empty(0)
    for i in range(trees.iterations):
        tree = empty(1)
        for level in range(trees.depth):
            growing = (tree.feature[:, 0], tree.bin[:, 0], tree.missing_left[:, 0])
            work = partial(_histograms, pending=pending, growing=growing, level=level, width=width)
            sums = _mapped(rows.select("_labels", "_folds", "_bins", "_scores"), work, "model int, node int, sums binary")
            pick = partial(
                _best_splits, n_features=len(features), width=width, l2=trees.l2, min_weight=trees.min_weight
            )
            together = sums.repartition("model", "node").sortWithinPartitions("model", "node")
            splits = _mapped(together, pick, SPLIT).toArrow().to_pydict()
            m, node = np.array(splits["model"], dtype=int), np.array(splits["node"], dtype=int)
            at = (1 << level) - 1 + node
            tree.feature[m, 0, at], tree.bin[m, 0, at] = splits["feature"], splits["bin"]
            tree.missing_left[m, 0, at], tree.gain[m, 0, at] = splits["missing_left"], splits["gain"]
            if level == trees.depth - 1:
                for side, (g, h) in enumerate((("gl", "hl"), ("gr", "hr"))):
                    value = -trees.step * np.array(splits[g]) / (np.array(splits[h]) + trees.l2)
                    tree.leaf[m, 0, 2 * node + side] = value
        grown.append(tree)
        pending = _joined([pending, tree])
        if pending.feature.shape[1] == WRITE_EVERY or i == trees.iterations - 1:
            work = partial(_advanced, pending=pending, keep=[*keep, "_labels", "_folds", "_bins"])
            rows = scratch.written(_mapped(rows, work, fields), instead_of=rows)
            pending = empty(0)
    return Fit(_joined(grown), rows, scratch)


def _joined(parts: Sequence[Ensemble]) -> Ensemble:
    first = parts[0]
    arrays = [
        np.concatenate([getattr(p, name) for p in parts], axis=1)
        for name in ("feature", "bin", "missing_left", "gain", "leaf")
    ]
    return Ensemble(first.features, first.cuts, first.models, first.depth, *arrays)


def _scored(batches, ensemble: Ensemble, keep: list[str], leaves: bool) -> Iterator[pa.RecordBatch]:
    base = np.array([m.base for m in ensemble.models])
    for batch in batches:
        bins = binned(_entries(batch.column("_x"), np.float64), ensemble.cuts)
        if leaves:
            values = _routed(
                bins, ensemble.feature[:, -1], ensemble.bin[:, -1], ensemble.missing_left[:, -1], ensemble.depth
            )
        else:
            values = probabilities(added_scores(bins, ensemble, np.tile(base, (len(bins), 1))), ensemble.models)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(bins) + 1) * values.shape[1], pa.int32()), pa.array(values.astype(float).ravel())
        )
        yield pa.record_batch([*batch.select(keep).columns, lists], names=[*keep, "_scores"])


def with_scores(df: DataFrame, ensemble: Ensemble, leaves: bool = False) -> DataFrame:
    """``df`` with ``_scores``, one entry per model, in one pass and without a shuffle.

    The features are those of the fit, found by name; a missing column is an error.
    With ``leaves`` the entries are the leaf numbers in the last tree instead.
    """
    absent = [f for f in ensemble.features if f not in df.columns]
    if absent:
        raise ValueError(f"features of the models are missing: {absent[:5]}")
    keep = df.columns
    source = df.select(*[f"`{c}`" for c in keep], _vectors(ensemble.features))
    work = partial(_scored, ensemble=ensemble, keep=keep, leaves=leaves)
    return _mapped(source, work, f"{_fields(df, keep)}, _scores array<double>")


# --- stored ensembles ---------------------------------------------------------

TREES = (
    "ensemble string, model int, round int, feature array<int>, bin array<int>, missing_left array<boolean>, "
    "gain array<double>, leaf array<float>"
)


def save(spark: SparkSession, ensembles: dict[str, Ensemble], path: str, described: dict) -> None:
    """Trees as Parquet under ``path``, then the description that makes the folder complete."""
    rows = [
        (
            name, m, r, e.feature[m, r].tolist(), e.bin[m, r].tolist(), e.missing_left[m, r].tolist(),
            e.gain[m, r].tolist(), e.leaf[m, r].tolist(),
        )
        for name, e in ensembles.items()
        for m in range(len(e.models))
        for r in range(e.feature.shape[1])
    ]
    spark.createDataFrame(rows, TREES).write.mode("overwrite").parquet(f"{path}/trees")
    shapes = {
        name: {
            "features": e.features, "cuts": [c.tolist() for c in e.cuts], "models": [asdict(m) for m in e.models],
            "depth": e.depth, "rounds": e.feature.shape[1],
        }
        for name, e in ensembles.items()
    }
    payload = json.dumps({**described, "ensembles": shapes})
    spark.createDataFrame([(payload,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load(spark: SparkSession, path: str) -> tuple[dict[str, Ensemble], dict]:
    """``(ensembles, description)``; trees that are missing or do not fit are an error."""
    described = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
    rows = spark.read.schema(TREES).parquet(f"{path}/trees").collect()
    ensembles = {}
    for name, shape in described.pop("ensembles").items():
        models = [Model(**m) for m in shape["models"]]
        size = (len(models), shape["rounds"])
        trees = {(r["model"], r["round"]): r for r in rows if r["ensemble"] == name}
        nodes = (1 << shape["depth"]) - 1
        if len(trees) != size[0] * size[1] or any(len(r["leaf"]) != nodes + 1 for r in trees.values()):
            raise ValueError(f"the trees of {name} are not those of its description")
        kinds = {"feature": np.int32, "bin": np.int16, "missing_left": bool, "gain": float, "leaf": np.float32}
        arrays = {
            c: np.array([[trees[m, r][c] for r in range(size[1])] for m in range(size[0])], dtype=kind)
            for c, kind in kinds.items()
        }
        cuts = [np.array(c, dtype=np.float64) for c in shape["cuts"]]
        ensembles[name] = Ensemble(shape["features"], cuts, models, shape["depth"], **arrays)
    return ensembles, described
