"""Text quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.llm.kernels import (
    IS_SPACE, arrow_map, coded, cut, line_spans, owners, sums, text_blocks, word_spans,
)
from cultiva.llm.tables import written

BLOCK_BYTES = 4 << 20
SAMPLE_PER_CLASS = 4000
FIT_SHARES = 4
FIT_STEPS = 60
RIDGE = 1e-3

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] = 1  # capital letters
_KIND[97:123] = 2  # small letters
_KIND[48:58] = 3  # digits
_KIND[[i for i in range(33, 127) if chr(i) in "#*$%&|<>{}[]\\~^_=+@/"]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[128:] = 2  # parts of other letters

OWN = (
    "log_words", "word_length", "capitals", "digits", "symbols", "marks", "shouts", "same_word_again",
    "few_words", "one_word", "line_again", "ends_sentence", "starts_capital", "bar_words",
)
# Of the line itself, the one before, the one behind; then whether there is none.
WIDTH = 3 * len(OWN) + 2 + 1


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, weights, line bounds of texts)`` of all lines with a word.

    A line is described by itself and by the lines before and behind it in the same
    text; its weight is its length in bytes without white space.
    """
    starts, ends, line_bounds = line_spans(data, bounds)
    word_starts, word_ends, _ = word_spans(data, bounds)
    words_of = np.searchsorted(word_starts, np.append(starts, len(data)))
    keep = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    text_of = owners(line_bounds)[keep]
    starts, ends = starts[keep], ends[keep]
    first, last = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    del words_of
    n = len(starts)
    text_bounds = np.searchsorted(text_of, np.arange(len(bounds)))
    if n == 0:
        return np.zeros((0, WIDTH)), np.zeros(0), text_bounds

    def in_words(values):
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (total[last] - total[first]).astype(np.float64)

    def in_bytes(chosen):
        total = np.concatenate([[0], np.cumsum(chosen, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    kinds = _KIND[data]
    n_words = (last - first).astype(np.float64)
    size = np.maximum(in_bytes(~IS_SPACE[data]), 1)
    codes = coded(cut(data, word_starts, word_ends))[0].astype(np.int64)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = codes[1:] == codes[:-1]
    again[first] = False
    line_of = np.repeat(np.arange(n), last - first)
    pair = np.unique(line_of * (int(codes.max()) + 1) + codes)
    distinct = np.bincount(pair // (int(codes.max()) + 1), minlength=n).astype(np.float64)
    line_codes = coded(cut(data, starts, ends))[0].astype(np.int64)
    seen = np.ones(n, dtype=bool)
    seen[np.unique(text_of * (int(line_codes.max()) + 1) + line_codes, return_index=True)[1]] = False
    letters = in_bytes((kinds == 1) | (kinds == 2))
    final = data[word_ends[last - 1] - 1]
    shout = (word_ends - word_starts > 1) & (data[word_ends - 1] == ord("!"))
    bar = (word_ends - word_starts == 1) & (kinds[word_starts] == 4)
    own = np.column_stack([
        np.log1p(n_words) / 4,
        np.minimum(size / n_words, 30) / 10,
        in_bytes(kinds == 1) / np.maximum(letters, 1),
        in_bytes(kinds == 3) / size,
        in_bytes(kinds == 4) / size,
        in_bytes(kinds == 5) / size,
        in_words(shout) / n_words,
        in_words(again) / n_words,
        1 - distinct / n_words,
        n_words == 1,
        seen,
        np.isin(final, np.frombuffer(b".!?\"')", dtype=np.uint8)),
        kinds[starts + 0] == 1,
        in_words(bar) / n_words,
    ]).astype(np.float64)
    before = np.zeros_like(own)
    after = np.zeros_like(own)
    joined = text_of[1:] == text_of[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    opens = np.concatenate([[True], ~joined])
    closes = np.concatenate([~joined, [True]])
    return np.column_stack([own, before, after, opens, closes, np.ones(n)]), size, text_bounds


@dataclass(frozen=True)
class LineField:
    """Weights of a chain over lines with the states 0 (bad) and 1 (good).

    ``emission`` weighs the features for state 1 (state 0 is the reference),
    ``transition[a, b]`` the step from a line of state a to one of state b.
    """

    emission: np.ndarray
    transition: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.emission, self.transition.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> LineField:
        return cls(flat[:WIDTH], flat[WIDTH:].reshape(2, 2))


def _scan(steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running products of 2x2 matrices within runs, by a parallel prefix scan.

    ``first[i]`` is the start of the run of item i. Products are scaled to a largest
    entry of 1; the logarithms of the scales come back as well.
    """
    product = steps.copy()
    scale = product.max(axis=(1, 2))
    product /= scale[:, None, None]
    log_scale = np.log(scale)
    here = np.arange(len(steps))
    step = 1
    longest = int((here - first).max()) + 1 if len(steps) else 0
    while step < longest:
        at = np.flatnonzero(here - step >= first)
        joined = product[at - step] @ product[at]
        scale = joined.max(axis=(1, 2))
        log_scale[at] = log_scale[at] + log_scale[at - step] + np.log(scale)
        product[at] = joined / scale[:, None, None]
        step *= 2
    return product, log_scale


def marginals(
    field: LineField, features: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: ``(P(line good), P(pair of neighbours), log Z of texts)``.

    The pair at line i is that of the lines i - 1 and i; it is zero at the first
    line of a text.
    """
    n = len(features)
    if n == 0:
        return np.zeros(0), np.zeros((0, 2, 2)), np.zeros(len(bounds) - 1)
    first = bounds[:-1][owners(bounds)]
    score = np.clip(features @ field.emission, -30, 30)
    local = np.exp(np.column_stack([-score / 2, score / 2]))
    move = np.exp(np.clip(field.transition, -30, 30))
    steps = move[None] * local[:, None, :]
    opens = first == np.arange(n)
    steps[opens] = local[opens][:, None, :]
    product, log_scale = _scan(steps, first)
    alpha = product[:, 0, :]
    # Backwards: the step from line i to line i + 1, in the order of the reversed row.
    follow = np.empty((n, 2, 2))
    follow[:-1] = (move[None] * local[1:, None, :])
    closes = np.append(opens[1:], True)
    follow[closes] = 1.0
    last = bounds[1:][owners(bounds)] - 1
    turned, _ = _scan(np.swapaxes(follow, 1, 2)[::-1], (n - 1 - last)[::-1])
    beta = turned[::-1][:, 0, :]
    joint = alpha * beta
    good = joint[:, 1] / joint.sum(axis=1)
    pairs = np.zeros((n, 2, 2))
    inner = np.flatnonzero(~opens)
    both = alpha[inner - 1][:, :, None] * move[None] * (local[inner] * beta[inner])[:, None, :]
    pairs[inner] = both / both.sum(axis=(1, 2))[:, None, None]
    log_z = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    ends = bounds[1:][some] - 1
    log_z[some] = log_scale[ends] + np.log(alpha[ends].sum(axis=1))
    return good, pairs, log_z


def _loss(flat, features, bounds, state, weight):
    """Weighted negative log-likelihood of line states, and its gradient."""
    field = LineField.of(flat)
    good, pairs, log_z = marginals(field, features, bounds)
    opens = np.zeros(len(state), dtype=bool)
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    score = np.clip(features @ field.emission, -30, 30)
    steps = np.zeros(len(state))
    steps[1:] = field.transition[state[:-1], state[1:]]
    steps[opens] = 0
    per_line = np.repeat(weight, np.diff(bounds))
    total = per_line.sum()
    loss = float((weight * log_z).sum() - (per_line * (score * (state - 0.5) + steps)).sum())
    grad_emission = features.T @ (per_line * (good - state))
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(~opens)
    np.add.at(seen, (state[inner - 1], state[inner]), per_line[inner])
    grad_transition = (pairs * per_line[:, None, None]).sum(axis=0) - seen
    grad = np.concatenate([grad_emission, grad_transition.ravel()]) / total + RIDGE * flat
    return loss / total + RIDGE / 2 * float(flat @ flat), grad


def _fit_share(features, bounds, state, weight, steps: int) -> np.ndarray:
    """Limited-memory quasi-Newton descent from zero."""
    x = np.zeros(WIDTH + 4)
    value, grad = _loss(x, features, bounds, state, weight)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction = grad.copy()
        used = []
        for s, y, rho in reversed(history):
            a = rho * (s @ direction)
            direction -= a * y
            used.append(a)
        if history:
            s, y, _ = history[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(history, reversed(used)):
            direction += (a - rho * (y @ direction)) * s
        slope, size = float(grad @ direction), 1.0
        if slope < 1e-12:
            break
        for _ in range(25):
            trial = x - size * direction
            new_value, new_grad = _loss(trial, features, bounds, state, weight)
            if new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = trial - x, new_grad - grad
        if s @ y > 1e-12:
            history = [*history[-9:], (s, y, 1 / (s @ y))]
        x, value, grad = trial, new_value, new_grad
    return x


def _fit(batches: Iterator[pa.RecordBatch], text: str, label: str, steps: int) -> Iterator[pa.RecordBatch]:
    """One row of weights from the labelled texts of this task."""
    parts, label_parts = [], []
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        features, _, line_bounds = line_features(data, bounds)
        parts.append((features, np.diff(line_bounds)))
        label_parts.append(rows.column(label).to_numpy())
    if not parts:
        return
    labels = np.concatenate(label_parts).astype(np.int64)
    sizes = np.concatenate([p[1] for p in parts])
    # A fixed order of rows, so that sums do not depend on how batches arrived.
    features = np.concatenate([p[0] for p in parts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if len(features) == 0:
        return
    # Texts count alike, whatever their number of lines, and so do both classes.
    share = np.bincount(labels, minlength=2)
    weight = 1 / np.maximum(sizes, 1) / np.maximum(share[labels], 1)
    weights = _fit_share(features, bounds, np.repeat(labels, sizes), weight * len(labels), steps)
    yield pa.record_batch(
        {
            "n": pa.array([len(labels)], pa.int64()),
            "both": pa.array([bool(share.all())]),
            "weights": pa.array([weights.tolist()]),
        }
    )


def fit_line_field(
    samples: DataFrame,
    labels: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    label: str = "quality",
    per_class: int = SAMPLE_PER_CLASS,
    steps: int = FIT_STEPS,
) -> LineField:
    """Fit the chain on texts whose lines all take the label of their text.

    ``labels`` has ``key`` and ``label`` (1 good, 0 bad); other values and null keys
    are left out, and a key with both labels counts as bad. Of each label the
    ``per_class`` keys with the smallest hash are used: a bounded sample, so the fit
    costs the same at any corpus size. The sample is dealt over a few tasks that
    fit alone, and their weights are averaged by numbers of texts; only these few
    rows of weights reach the driver. Without labelled texts all weights are zero.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(key)
        .agg(F.min(F.col(label).cast("int")).alias("_label"))
    )
    order = F.xxhash64(key)
    chosen = [known.filter(F.col("_label") == v).orderBy(order, key).limit(per_class) for v in (0, 1)]
    # At most 2 * per_class short rows: safe to broadcast.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = (
        samples.select(key, text)
        .join(picked, key)
        .select(key, F.coalesce(text, F.lit("")).alias(text), F.col("_label").cast("int"))
    )
    dealt = written(rows).repartition(FIT_SHARES, key).sortWithinPartitions("_label", key, text)
    shares = arrow_map(
        dealt, partial(_fit, text=text, label="_label", steps=steps), "n bigint, both boolean, weights array<double>"
    ).collect()
    # A task that saw one label only learnt nothing; it counts if all were like that.
    shares = [row for row in shares if row["both"]] or shares
    fitted = sorted((row["n"], row["weights"]) for row in shares)
    if not fitted:
        return LineField(np.zeros(WIDTH), np.zeros((2, 2)))
    total = sum(n for n, _ in fitted)
    return LineField.of(sum(np.array(w) * (n / total) for n, w in fitted))


def _score(batches: Iterator[pa.RecordBatch], text: str, field: LineField) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches, text, BLOCK_BYTES):
        features, weights, line_bounds = line_features(data, bounds)
        good, _, _ = marginals(field, features, line_bounds)
        mass = sums(weights, line_bounds)
        score = np.divide(sums(weights * good, line_bounds), mass, out=np.zeros(len(mass)), where=mass > 0)
        out = rows.drop_columns([text])
        out = out.append_column("n_lines", pa.array(np.diff(line_bounds), pa.int64()))
        out = out.append_column("score", pa.array(np.clip(score, 0, 1), pa.float64()))
        yield from out.combine_chunks().to_batches()


def score_lines(
    samples: DataFrame, field: LineField, key: str = "bacdive_id", text: str = "iso_sample_text"
) -> DataFrame:
    """``(key, n_lines, score)``: quality of every isolation text, 0 to 1.

    The score is the mean probability of its lines being good, by forward and
    backward passes over the whole text, weighted with their lengths. A text without
    a word, empty or null, has no lines and scores 0. Repeated rows and null keys
    stay rows of their own; other columns are ignored. There is no shuffle, and the
    passes are parallel scans, so a text may have any number of lines.
    """
    chosen = samples.select(key, text)
    kind = chosen.schema[key].dataType.simpleString()
    return arrow_map(
        chosen, partial(_score, text=text, field=field), f"`{key}` {kind}, n_lines bigint, score double"
    )
