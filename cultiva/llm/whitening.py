"""Whitened genome embeddings by spectrum slicing of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.llm.kernels import arrow_map
from cultiva.llm.tables import written

# Production parameters: components, and the fixed-point grid of vector entries.
COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
# Components below this share of the largest eigenvalue are rounding noise.
LEAST_SHARE = 1e-10
# Grid entries that sums and products still hold exactly.
LARGEST = 1 << 40
# Vectors centred and multiplied at once.
ROWS = 4096


# --- spectrum slicing ---------------------------------------------------------


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``.

    LDL' of ``matrix - shift * I`` with symmetric pivoting (Bunch and Kaufman): by
    Sylvester's law D has as many positive eigenvalues as the shifted matrix. A
    pivot is one entry, or a 2x2 block of determinant below zero (one eigenvalue of
    either sign).
    """
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0
    ratio = (1 + np.sqrt(17)) / 8
    while k < n:
        rest = np.abs(a[k + 1 :, k])
        widest = rest.max() if len(rest) else 0.0
        pivot, r, pair = k, k, False
        if max(abs(a[k, k]), widest) == 0:
            k += 1
            continue
        if abs(a[k, k]) < ratio * widest:
            r = k + 1 + int(rest.argmax())
            column = np.abs(a[k:, r])
            column[r - k] = 0
            across = column.max()
            if abs(a[k, k]) * across >= ratio * widest**2:
                r = k
            elif abs(a[r, r]) >= ratio * across:
                pivot = r
            else:
                pair = True
        if pair:
            _swap(a, k + 1, r)
            block, below = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            signs = np.linalg.eigvalsh(block)
            positive += int((signs > 0).sum())
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
            k += 2
        else:
            _swap(a, k, pivot)
            d, below = a[k, k], a[k + 1 :, k].copy()
            positive += int(d > 0)
            a[k + 1 :, k + 1 :] -= np.outer(below / d, below)
            k += 1
    return positive


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def leading_components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, unit eigenvectors in columns)`` by falling eigenvalue.

    Counts of eigenvalues above a shift isolate each eigenvalue between two shifts.
    Rayleigh quotient iteration starts inside the interval and converges
    cubically. Its result stands once counts just above and just below it certify
    its number; until then the interval is halved and the iteration starts again.
    Eigenvalues closer to each other than rounding are one cluster: counts certify
    its size, and its vectors are kept orthogonal. Fewer than ``wanted`` come back
    where the rest is below :data:`LEAST_SHARE` of the first.
    """
    n = len(covariance)
    norm = float(np.abs(covariance).sum(axis=1).max()) if n else 0.0
    if norm == 0:
        return np.zeros(0), np.zeros((n, 0))
    blur = 8 * n * np.finfo(float).eps * norm
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(covariance, shift)
        return counts[shift]

    # Every shift counted so far narrows the search for all later components.
    counts[norm + blur] = 0
    counts[-blur] = n
    values: list[float] = []
    vectors = np.zeros((n, 0))
    while len(values) < min(wanted, n):
        k = len(values)
        high = min(s for s, c in counts.items() if c <= k)
        low = max(s for s, c in counts.items() if c > k)
        while above(low) > k + 1 and high - low > blur:
            middle = (low + high) / 2
            if above(middle) > k:
                low = middle
            else:
                high = middle
        size = min(above(low), n) - k  # one, or a cluster
        found = None
        while found is None:
            found = _iterated(covariance, vectors, (low + high) / 2, size, blur)
            top, bottom = found[0][0] + blur, found[0][-1] - blur
            if above(top) > k or above(bottom) < k + size:
                found = None
                middle = (low + high) / 2
                if high - low <= blur:
                    raise ArithmeticError("an eigenvalue could not be certified")
                if above(middle) > k:
                    low, size = middle, min(above(middle), n) - k
                else:
                    high = middle
        if found[0][0] <= LEAST_SHARE * (values[0] if values else found[0][0]) or found[0][0] <= blur:
            break
        values += list(found[0])
        vectors = np.concatenate([vectors, found[1]], axis=1)
    values, vectors = np.array(values[:wanted]), vectors[:, :wanted]
    sure = values > LEAST_SHARE * values[0] if len(values) else np.zeros(0, dtype=bool)
    return values[sure], vectors[:, sure]


def _iterated(matrix, known, shift, size, blur) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh quotient iteration for ``size`` vectors at ``shift``, orthogonal to ``known``."""
    n = len(matrix)
    rng = np.random.default_rng(known.shape[1])
    basis = _orthonormal(rng.standard_normal((n, size)), known)
    # Two steps of inverse iteration point the start at the isolated eigenvalue.
    for _ in range(2):
        basis = _orthonormal(_solved(matrix, shift, basis, blur), known)
    for column in range(size):
        others = np.concatenate([known, basis[:, :column]], axis=1)
        x = _orthonormal(basis[:, column : column + 1], others)
        for _ in range(12):
            quotient = float((x.T @ matrix @ x)[0, 0])
            residual = float(np.linalg.norm(matrix @ x - quotient * x))
            if residual <= blur / 16:
                break
            x = _orthonormal(_solved(matrix, quotient, x, blur), others)
        basis[:, column : column + 1] = x
    quotients = np.einsum("ij,ij->j", basis, matrix @ basis)
    order = np.argsort(-quotients, kind="stable")
    return quotients[order], basis[:, order]


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, blur: float) -> np.ndarray:
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, right)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue
        return np.linalg.solve(shifted + blur * np.eye(len(matrix)) / 64, right)


def _orthonormal(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    x = x / np.linalg.norm(x, axis=0)
    for _ in range(2):
        x = x - known @ (known.T @ x)
    return np.linalg.qr(x)[0]


# --- passes over the vectors --------------------------------------------------


def _grid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, x)``: places of whole vectors, and the entries of all of them in a row.

    A vector that is null, empty or holds a null or non-finite entry is left out.
    """
    lists = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64())
    values = entries.to_numpy(zero_copy_only=False)  # nulls become NaN
    sound = np.isfinite(values)
    bounds = np.concatenate([[0], np.cumsum(lists)])
    bad = np.concatenate([[0], np.cumsum(~sound)])
    whole = (bad[bounds[1:]] == bad[bounds[:-1]]) & (lists > 0)
    x = np.floor(SCALE * values[np.repeat(whole, lists)])
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"vector entries beyond {LARGEST // SCALE} cannot be held exactly")
    return np.flatnonzero(whole), x.astype(np.int64) + SHIFT


def _list_column(x: np.ndarray, lengths: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(x, kind)
    )


def _gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        rows, x = _grid(column)
        lengths = pc.list_value_length(column).take(pa.array(rows)).to_numpy(zero_copy_only=False)
        yield pa.record_batch({"x": _list_column(x, lengths, pa.int64())})


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(width, dtype=np.int64), 0
    for batch in batches:
        x = _matrix(batch, width)
        total += (x - SHIFT).sum(axis=0)
        n += len(x)
    if n:
        yield pa.record_batch({"at": pa.array(np.arange(width), pa.int32()), "total": total, "n": np.full(width, n)})


def _products(batches: Iterator[pa.RecordBatch], width: int, model: dict) -> Iterator[pa.RecordBatch]:
    """Partial sums of products of centred (and projected) entries, one row per line of the matrix."""
    product = None
    for batch in batches:
        x = _matrix(batch, width)
        for i in range(0, len(x), ROWS):
            part = _projected(x[i : i + ROWS], model)
            product = part.T @ part if product is None else product + part.T @ part
    if product is not None:
        yield pa.record_batch(
            {
                "at": pa.array(np.arange(len(product)), pa.int32()),
                "line": _list_column(product.ravel(), np.full(len(product), len(product)), pa.float64()),
            }
        )


def _projected(x: np.ndarray, model: dict) -> np.ndarray:
    """``x - S / n`` in double, projected if the model holds axes."""
    n = model["n"]
    # Whole part and rest apart: the difference keeps all its digits.
    whole, rest = np.divmod(model["S"], n)
    centred = (x - whole).astype(np.float64) - rest / n
    return centred @ model["axes"] if "axes" in model else centred


def _added(lines: DataFrame) -> np.ndarray:
    """The matrix whose partial lines are spread over the tasks; entries are added on the executors."""
    entries = lines.select("at", F.posexplode("line").alias("column", "value"))
    rows = entries.groupBy("at", "column").agg(F.sum("value").alias("value")).collect()
    size = 1 + max((r["at"] for r in rows), default=-1)
    matrix = np.zeros((size, size))
    for r in rows:
        matrix[r["at"], r["column"]] = r["value"]
    return (matrix + matrix.T) / 2


def _whitened(batches, vector: str, model: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
    width, k = len(model["S"]), model["axes"].shape[1]
    big = [int(s) for s in model["S"]]
    for batch in batches:
        column = batch.column(vector)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(lengths == width)
        batch = batch.take(pa.array(fits))
        rows, x = _grid(batch.column(vector))
        x = x.reshape(-1, width)
        n = len(x)
        spread = model["n"] * x - model["S"]
        if n and float((np.abs(spread.astype(np.float64)) ** 2).sum(axis=1).max()) < 2.0**62:
            deviation = (spread**2).sum(axis=1)
        else:  # beyond 64 bits on the way: Python's integers, and an error if the sum itself is
            deviation = [sum((model["n"] * int(e) - s) ** 2 for e, s in zip(row, big)) for row in x]
        at = np.repeat(np.arange(n), k)
        out = pa.Table.from_batches([batch.select(names)]).take(pa.array(rows)).take(pa.array(at))
        columns = {
            "component": pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
            "n": pa.array(np.full(n * k, model["n"]), pa.int64()),
            "deviation": pa.array(deviation, pa.int64()).take(pa.array(at)),
            "whitened": pa.array(_projected(x, model).ravel(), pa.float64()),
            "explained": pa.array(np.tile(model["explained"], n), pa.float64()),
            "identity_error": pa.array(np.full(n * k, model["identity_error"]), pa.float64()),
        }
        for name, values in columns.items():
            out = out.append_column(name, values)
        yield from out.combine_chunks().to_batches()


RESULT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whitened_embeddings(
    embeddings: DataFrame,
    key: str = "genome_accession",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """Genome embeddings along their leading principal axes, each axis of variance 1.

    One row per vector and component: ``key``, ``component`` (from 1, by falling
    eigenvalue), ``n`` (distinct vectors of the fit), ``deviation`` (sum over
    dimensions of ``(n * x - S)**2``, exact), ``whitened``, ``explained`` (share of the
    variance) and ``identity_error`` (largest absolute entry of the covariance of
    ``whitened`` over the fit, minus the identity). Entries are put on a grid first:
    ``x = floor(64 * entry) + 1000000``. The fit takes every distinct vector once, with
    sums ``S`` in exact integers, and a covariance centred before multiplying, divisor
    ``n``. Eigenvectors come from :func:`leading_components`.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out.
    So are vectors of another length than most distinct ones (ties: the longer); entries
    beyond 2**34 and a ``deviation`` beyond 64 bits are errors. Repeated rows and null
    keys keep rows of their own. Components without variance have no rows; a table
    without a vector, or with one distinct vector, gives an empty result. Other columns
    are ignored.

    Vectors stay on the executors. The driver holds one matrix of dimension squared,
    whatever the number of rows; each task of the fit sends one such matrix.
    """
    if key in RESULT or components < 1:
        raise ValueError("components must be positive, and key no column of the result")
    spark = embeddings.sparkSession
    chosen = embeddings.select(f"`{key}`", f"`{vector}`")
    grid = arrow_map(chosen.select(f"`{vector}`"), _gridded, "x array<bigint>")
    fit = written(grid.distinct())
    lengths = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    names = [key]
    kind = chosen.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["width"]
    fit = fit.filter(F.size("x") == width)
    sums = (
        arrow_map(fit, partial(_sums, width=width), "at int, total bigint, n bigint")
        .groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    )
    n = sums[0]["n"]
    model = {"n": n, "S": np.array([r["total"] + n * SHIFT for r in sums], dtype=np.int64)}
    lines = "at int, line array<double>"
    covariance = _added(arrow_map(fit, partial(_products, width=width, model=model), lines)) / n
    values, vectors = leading_components(covariance, components)
    if len(values) == 0:
        return spark.createDataFrame([], schema)
    model["axes"] = vectors / np.sqrt(values)
    model["explained"] = values / np.trace(covariance)
    # The whitened entries have mean 0, as they are centred by the exact sums.
    again = _added(arrow_map(fit, partial(_products, width=width, model=model), lines)) / n
    model["identity_error"] = float(np.abs(again - np.eye(len(again))).max())
    return arrow_map(chosen, partial(_whitened, vector=vector, model=model, names=names), schema)
