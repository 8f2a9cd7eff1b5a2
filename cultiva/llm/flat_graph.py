"""Near-duplicate embeddings by search over a robust-pruned flat graph."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.llm.kernels import arrow_map, binary_column, mixed, to_signed
from cultiva.llm.tables import components, written

THRESHOLD = 0.95
SAMPLE = 20_000
SHARD_VECTORS = 1500
MAX_CENTROIDS = 2000
MARGIN = 0.17
# A vector is a node in so many shards at most; the others within the margin it visits.
MAX_SHARDS = 8
# As many nodes as shards of usual density have: their members walk one block, not two.
BLOCK_VECTORS = MAX_SHARDS * SHARD_VECTORS
ASK_VECTORS = 16_000
PLACED_ROWS = 8192
DEGREE = 24
CANDIDATES = 48
FAR_EDGES = 4
ALPHA = 1.2
BEAM = 24
# Nodes of a beam that are expanded at once.
EXPANDED = 4
FRONT_NEIGHBOURS = 1 << 19
SCORED_PAIRS = 4096
DECIDED_PAIRS = 1 << 14
AUDIT = 256
LEAST_RECALL = 0.9


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(length, vectors)``: the double unit vector of every usable row, length 0 for others."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.zeros(len(column), dtype=np.int64)
    found = []
    for i, value in enumerate(column):
        x = None if not value.is_valid else value.values
        if x is not None and len(x) and x.null_count == 0:
            v = x.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(v).all():
                largest = np.abs(v).max()
                if largest > 0:
                    v = v / largest  # squares of very large or small entries stay finite
                    sizes[i] = len(v)
                    found.append(v / np.sqrt(v @ v))
                    continue
        found.append(np.zeros(0))
    return sizes, found


def _classes(batches, key: str, vector: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, found = unit_vectors(batch.column(vector))
        raw = [v.tobytes() for v in found]
        cls = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], dtype=np.uint64)
        empty = sizes == 0
        yield pa.record_batch(
            {
                key: batch.column(key),
                "size": pa.array(sizes, pa.int32()),
                "cls": pa.array(to_signed(cls), pa.int64(), mask=empty),
                "vec": pa.array([None if e else r for e, r in zip(empty, raw)], pa.binary()),
            }
        )


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty cluster keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(1))
        centres = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centres)
    return centres


def _assign(batches, centroids, margin: float, most: int) -> Iterator[pa.RecordBatch]:
    """Shards of every vector: those whose centre is nearly as close as the closest.

    In the closest ``most`` the vector becomes a node (``base``), the rest it visits.
    """
    centres = centroids.value
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        if not raw:
            continue
        similar = _matrix(raw) @ centres.T
        top = np.argsort(-similar, axis=1, kind="stable")
        value = np.take_along_axis(similar, top, axis=1)
        owner, place = np.nonzero(value >= value[:, :1] - margin)
        for lo in range(0, len(owner), PLACED_ROWS):
            who, turn = owner[lo : lo + PLACED_ROWS], place[lo : lo + PLACED_ROWS]
            yield pa.record_batch(
                {
                    "cls": batch.column("cls").take(pa.array(who)),
                    "shard": pa.array(top[who, turn], pa.int32()),
                    "home": pa.array(turn == 0),
                    "base": pa.array(turn < most),
                    "vec": batch.column("vec").take(pa.array(who)),
                }
            )


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of every node out of its candidates ``near`` (closest first), -1 padded.

    The closest candidate is taken; every other one that is closer to it, by the
    factor ``alpha``, than to the node goes. And again, ``degree`` times at most.
    """
    chosen = np.full((len(x), degree), -1, dtype=np.int64)
    for lo in range(0, len(x), 512):
        hi = min(lo + 512, len(x))
        cand = near[lo:hi]
        v = x[cand]
        to_node = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("icd,id->ic", v, x[lo:hi])))
        between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
        open_ = cand != np.arange(lo, hi)[:, None]
        row = np.arange(hi - lo)
        for turn in range(degree):
            some = open_.any(axis=1)
            if not some.any():
                break
            first = open_.argmax(axis=1)
            chosen[lo:hi, turn] = np.where(some, cand[row, first], -1)
            open_[row, first] = False
            open_ &= alpha * between[row, first] > to_node
    return chosen


def closest(similar: np.ndarray, c: int) -> np.ndarray:
    """Places of the ``c`` largest entries of every row, in no order.

    The c-th largest of the maxima of groups of columns is a bar that c entries reach.
    """
    n = similar.shape[1]
    if n < 32 * c:
        return np.argpartition(similar, n - c, axis=1)[:, n - c :]
    groups = np.maximum.reduceat(similar, np.arange(0, n, n // (4 * c)), axis=1)
    m = groups.shape[1]
    bar = np.partition(groups, m - c, axis=1)[:, m - c]
    row, column = np.nonzero(similar >= bar[:, None])
    held = np.bincount(row, minlength=len(similar))
    place = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    most = np.full((len(similar), int(held.max())), -9, dtype=similar.dtype)
    names = np.zeros(most.shape, dtype=np.int64)
    most[row, place], names[row, place] = similar[row, column], column
    top = np.argpartition(most, most.shape[1] - c, axis=1)[:, most.shape[1] - c :]
    return np.take_along_axis(names, top, axis=1)


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(from, to)`` of the pruned graph of one shard, both ways, with far edges."""
    n = len(x)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = min(CANDIDATES, n - 1)
    near = np.empty((n, c), dtype=np.int64)
    x = x.astype(np.float32)  # edges only lead the walk
    for lo in range(0, n, 512):
        similar = x[lo : lo + 512] @ x.T
        similar[np.arange(len(similar)), np.arange(lo, lo + len(similar))] = -2
        top = closest(similar, c)
        order = np.argsort(-np.take_along_axis(similar, top, axis=1), axis=1, kind="stable")
        near[lo : lo + 512] = np.take_along_axis(top, order, axis=1)
    pruned = robust_prune(x, near, min(DEGREE, c), ALPHA)
    start = np.repeat(np.arange(n), pruned.shape[1])
    keep = pruned.ravel() >= 0
    a, b = start[keep], pruned.ravel()[keep]
    # Edges back, of which a node that many have chosen keeps the closest.
    closeness = np.einsum("id,id->i", x[a], x[b])
    order = np.lexsort((-closeness, b))
    turn = np.arange(len(order)) - np.searchsorted(b[order], b[order])
    back = order[turn < DEGREE]
    # Far edges, fixed by place: a tight group of copies stays reachable.
    far = (mixed(np.arange(n * FAR_EDGES, dtype=np.uint64)) % np.uint64(n)).astype(np.int64)
    a, b = (
        np.concatenate([a, b[back], np.repeat(np.arange(n), FAR_EDGES)]),
        np.concatenate([b, a[back], far]),
    )
    pair = np.unique(a * n + b)
    a, b = pair // n, pair % n
    return a[a != b], b[a != b]


def _build(table: pa.Table) -> pa.Table:
    """Adjacency lists of one shard block."""
    table = table.sort_by("cls")
    cls = table.column("cls").to_numpy()
    a, b = build_graph(_matrix(table.column("vec").to_pylist()))
    edges = np.searchsorted(a, np.arange(len(cls) + 1))
    return pa.table(
        {"cls": table.column("cls"), "near": binary_column(np.ascontiguousarray(cls[b]).view(np.uint8), edges * 8)}
    )


def search(
    x: np.ndarray, edges: np.ndarray, near: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, width_of_beam: int = BEAM
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, node)`` with a cosine of ``threshold`` or more, by walking the graph.

    ``near[edges[i]:edges[i + 1]]`` are the neighbours of node i. A beam search from
    the medoid leads every query to its region; a query that is a node itself
    (``own``, else -1) also starts there. From all nodes in range the search then
    expands over their neighbours until no new one is in range.
    """
    n = len(x)
    degrees = np.diff(edges)
    width = max(1, int(degrees.max())) if n else 1
    table = np.full((n + 1, width), n, dtype=np.int64)
    table[np.repeat(np.arange(n), degrees), np.arange(len(near)) - np.repeat(edges[:-1], degrees)] = near
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    # Single precision leads the way; what it puts in range or just below is decided in double.
    x32, queries32 = x.astype(np.float32), queries.astype(np.float32)
    doubt = threshold - 1e-6 * (x.shape[1] + 8)
    out_q, out_n = [], []

    def in_range(who: np.ndarray, others: np.ndarray) -> np.ndarray:
        parts = [slice(k, k + DECIDED_PAIRS) for k in range(0, len(who), DECIDED_PAIRS)]
        close = [np.einsum("id,id->i", queries[who[at]], x[others[at]]) >= threshold for at in parts]
        return np.concatenate([np.zeros(0, dtype=bool), *close])

    for lo in range(0, len(queries), 128):
        q = queries32[lo : lo + 128]
        row = np.arange(len(q))
        # When a query met a node, 0 if it has not; node n pads the lists.
        met = np.zeros((len(q), n + 1), dtype=np.int32)
        met[:, n] = 1
        met[row, medoid] = 1
        flat = met.ravel()
        beam = np.full((len(q), width_of_beam), n, dtype=np.int64)
        score = np.full((len(q), width_of_beam), -9, dtype=np.float32)
        fresh = np.zeros((len(q), width_of_beam), dtype=bool)
        beam[:, 0], score[:, 0], fresh[:, 0] = medoid, q @ x32[medoid], True
        itself = own[lo : lo + 128]
        mine = itself >= 0
        extra = mine & (itself != medoid)
        beam[extra, 1] = itself[extra]
        score[extra, 1] = np.einsum("id,id->i", q[extra], x32[itself[extra]])
        fresh[extra, 1] = True
        met[row[mine], itself[mine]] = 1
        maybe = (score >= doubt) & (beam < n)
        hits_q, hits_n = [np.nonzero(maybe)[0]], [beam[maybe]]
        turn = 2
        while (active := np.flatnonzero(fresh.any(axis=1))).size:
            # The closest few nodes of every beam that were not expanded yet.
            open_ = np.where(fresh[active], score[active], np.float32(-99))
            best = np.argpartition(-open_, EXPANDED - 1, axis=1)[:, :EXPANDED]
            node = np.where(np.take_along_axis(fresh[active], best, axis=1), beam[active[:, None], best], n)
            fresh[active[:, None], best] = False
            cell = (table.take(node, axis=0).reshape(len(active), -1) + (active * (n + 1))[:, None]).ravel()
            fresh_at = np.flatnonzero(flat.take(cell) == 0)
            cell = cell.take(fresh_at)
            # A node that stands in two of the lists counts once.
            stamp = np.arange(turn, turn + len(cell), dtype=np.int32)
            flat[cell] = stamp
            once = np.flatnonzero(flat.take(cell) == stamp)
            turn += len(cell)
            cell, r = cell.take(once), fresh_at.take(once) // (node.shape[1] * width)
            who = active.take(r)
            other = cell - who * (n + 1)
            found = np.empty(len(r), dtype=np.float32)
            for k in range(0, len(r), SCORED_PAIRS):
                at = slice(k, k + SCORED_PAIRS)
                found[at] = np.einsum("id,id->i", x32.take(other[at], axis=0), q.take(who[at], axis=0))
            close = found >= doubt
            hits_q.append(who[close])
            hits_n.append(other[close])
            # Nodes closer than a beam's last, side by side for each query, are taken into it.
            better = np.flatnonzero(found > score.min(axis=1)[who])
            r, other, found = r.take(better), other.take(better), found.take(better)
            if len(r) == 0:
                continue
            held = np.bincount(r, minlength=len(active))
            place = np.arange(len(r)) - np.repeat(np.cumsum(held) - held, held)
            new = np.full((len(active), max(1, int(held.max()))), -9, dtype=np.float32)
            names = np.full(new.shape, n, dtype=np.int64)
            new[r, place], names[r, place] = found, other
            joined = np.concatenate([score[active], new], axis=1)
            top = np.argpartition(-joined, width_of_beam - 1, axis=1)[:, :width_of_beam]
            score[active] = np.take_along_axis(joined, top, axis=1)
            beam[active] = np.take_along_axis(np.concatenate([beam[active], names], axis=1), top, axis=1)
            opened = np.concatenate([fresh[active], new > -9], axis=1)
            fresh[active] = np.take_along_axis(opened, top, axis=1)
        front_q, front_n = np.concatenate(hits_q), np.concatenate(hits_n)
        sure = in_range(front_q + lo, front_n)
        front_q, front_n = front_q[sure], front_n[sure]
        while len(front_q):
            out_q.append(front_q + lo)
            out_n.append(front_n)
            next_q, next_n = [], []
            # A slice of the front at a time: its neighbours fit in a few megabytes.
            step = max(1, FRONT_NEIGHBOURS // width)
            for i in range(0, len(front_q), step):
                who, others = front_q[i : i + step], table[front_n[i : i + step]]
                r, w = np.nonzero(met[who[:, None], others] == 0)
                pair = np.unique(who[r] * (n + 1) + others[r, w])
                who, others = pair // (n + 1), pair % (n + 1)
                met[who, others] = 1
                close = in_range(who + lo, others)
                next_q.append(who[close])
                next_n.append(others[close])
            empty = np.zeros(0, dtype=np.int64)
            front_q, front_n = np.concatenate([empty, *next_q]), np.concatenate([empty, *next_n])
    if not out_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_q), np.concatenate(out_n)


def _search(table: pa.Table, threshold: float, beam: int) -> pa.Table:
    """Linked class pairs of one block: base rows form the graph, query rows walk it."""
    table = table.sort_by("cls")
    base = np.flatnonzero(table.column("base").to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
    cls = table.column("cls").to_numpy()
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if len(base) == 0 or len(asks) == 0:
        return empty
    x = _matrix(table.column("vec").to_pylist())
    nodes = cls[base]
    lists = [np.frombuffer(v, dtype=np.int64) if v else np.zeros(0, dtype=np.int64)
             for v in table.column("near").take(pa.array(base)).to_pylist()]
    owner = np.repeat(np.arange(len(base)), [len(v) for v in lists])
    near = np.concatenate(lists)
    # Of the united lists, the neighbours that are in this block.
    place = np.minimum(np.searchsorted(nodes, near), len(nodes) - 1)
    here = nodes[place] == near
    owner, place = owner[here], place[here]
    edges = np.searchsorted(owner, np.arange(len(base) + 1))
    own = np.searchsorted(nodes, cls[asks])
    own = np.where((own < len(nodes)) & (nodes[np.minimum(own, len(nodes) - 1)] == cls[asks]), own, -1)
    q, found = search(x[base], edges, place, x[asks], own, threshold, beam)
    a, b = cls[asks][q], nodes[found]
    keep = a != b
    pair = np.unique(np.column_stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]), axis=0)
    return pa.table({"a": pa.array(pair[:, 0], pa.int64()), "b": pa.array(pair[:, 1], pa.int64())})


def _audit(batches, queries, threshold: float) -> Iterator[pa.RecordBatch]:
    names, x = queries.value
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        if not raw:
            continue
        cls = batch.column("cls").to_numpy()
        i, j = np.nonzero(_matrix(raw) @ x.T >= threshold)
        differ = cls[i] != names[j]
        asked, other = names[j][differ], cls[i][differ]
        yield pa.record_batch(
            {
                "asked": pa.array(asked),
                "a": pa.array(np.minimum(asked, other)),
                "b": pa.array(np.maximum(asked, other)),
            }
        )


def audited_recall(classes: DataFrame, pairs: DataFrame, n: int = AUDIT, threshold: float = THRESHOLD) -> float:
    """Share of its true pairs that ``pairs`` holds, averaged over ``n`` sampled classes that have some.

    A class counts once however many pairs it has, so large groups cannot hide small
    ones; 1 if no class has a pair. The sample (smallest hashes, bounded) is held
    against all vectors by brute force.
    """
    rows = classes.select("cls", "vec").orderBy(F.xxhash64("cls")).limit(n).collect()
    if not rows:
        return 1.0
    sample = (np.array([r["cls"] for r in rows]), _matrix([bytes(r["vec"]) for r in rows]))
    queries = classes.sparkSession.sparkContext.broadcast(sample)
    true = arrow_map(
        classes.select("cls", "vec"),
        partial(_audit, queries=queries, threshold=threshold),
        "asked bigint, a bigint, b bigint",
    )
    found = true.join(pairs.withColumn("_hit", F.lit(1)), ["a", "b"], "left")
    of_class = found.groupBy("asked").agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))
    recall = of_class.agg(F.avg("share").alias("recall")).first()["recall"]
    return 1.0 if recall is None else recall


def _linked(classes: DataFrame, n: int, threshold: float, margin: float, beam: int) -> DataFrame:
    """Unique class pairs ``a < b`` found over the graph of equally long vectors."""
    spark = classes.sparkSession
    drawn = classes.orderBy(F.xxhash64("cls")).limit(SAMPLE).select("vec").collect()
    sample = _matrix([bytes(r["vec"]) for r in drawn])
    k = max(1, min(-(-n // SHARD_VECTORS), MAX_CENTROIDS, len(sample)))
    centroids = spark.sparkContext.broadcast(fit_centroids(sample, k))
    placed = written(
        arrow_map(
            classes.select("cls", "vec"),
            partial(_assign, centroids=centroids, margin=margin, most=MAX_SHARDS),
            "cls bigint, shard int, home boolean, base boolean, vec binary",
        )
    )
    # One row per shard, at most MAX_CENTROIDS: safe to broadcast.
    blocks = placed.groupBy("shard").agg(
        F.ceil(F.count_if("base") / BLOCK_VECTORS).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("home") | ~F.col("base")) / ASK_VECTORS)).cast("int").alias("parts"),
    )
    placed = placed.join(F.broadcast(blocks.filter("blocks > 0")), "shard")
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("cls", F.lit("part")), F.col("parts")).cast("int")
    nodes = placed.filter("base").withColumn("block", block)
    lists = nodes.select("shard", "block", "cls", "vec").groupBy("shard", "block").applyInArrow(
        _build, "cls bigint, near binary"
    )
    # Lists of a vector's shards, united; restricted to a block when it is searched.
    united = written(lists.groupBy("cls").agg(F.array_join(F.transform(F.collect_list("near"), F.hex), "").alias("_hex")))
    united = united.select("cls", F.unhex("_hex").alias("near"))
    # The nodes of a block are there for every part of those that ask.
    graph = (
        nodes.join(united, "cls")
        .withColumn("_own", part)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "shard", "block", "part", "cls", "vec", "near", F.lit(True).alias("base"),
            (F.col("home") & (F.col("part") == F.col("_own"))).alias("asks"),
        )
    )
    # Shards visited, and the other blocks of the home shard, are asked block by block.
    visits = (
        placed.filter("(home and blocks > 1) or not base")
        .withColumn("_own", block)
        .withColumn("part", part)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter("not home or block <> _own")
        .select(
            "shard", "block", "part", "cls", "vec", F.lit(None).cast("binary").alias("near"),
            F.lit(False).alias("base"), F.lit(True).alias("asks"),
        )
    )

    def walked(table: pa.Table) -> pa.Table:
        return _search(table, threshold, beam)

    found = graph.unionByName(visits).groupBy("shard", "block", "part").applyInArrow(walked, "a bigint, b bigint")
    return found.distinct()


def _widened(classes: DataFrame, n: int, threshold: float, audit: int, size: int) -> DataFrame:
    """Linked pairs of one length; margin and beam grow until the audit is content.

    Linked unit vectors differ by ``d = sqrt(2 - 2 * threshold)`` at most, so within a
    margin of ``2 * d`` every one of them visits the home shard of the other.
    """
    surest = 2 * math.sqrt(max(0.0, 2 - 2 * threshold))
    recall = 0.0
    for margin, beam in ((MARGIN, BEAM), (2 * MARGIN, 2 * BEAM), (surest, 4 * BEAM)):
        linked = written(_linked(classes, n, threshold, margin, beam))
        if not audit:
            return linked
        recall = audited_recall(classes, linked, audit, threshold)
        if recall >= LEAST_RECALL:
            return linked
    raise RuntimeError(f"recall {recall:.3f} of vectors of length {size} at the widest margin: raise BEAM or DEGREE")


def embedding_duplicates(
    vectors: DataFrame,
    key: str = "genome_accession",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    audit: int = AUDIT,
) -> DataFrame:
    """``(key, n_links, component_id, kept)``: near-duplicate genome embeddings.

    Two vectors link when their cosine, in double precision, is ``threshold`` or
    more. ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest ``key`` reachable over links, ``kept`` says that it is the row's own.
    Vectors that are null, empty, zero or hold a null or non-finite entry, and those
    of another length, link with nothing (each length forms a corpus of its own).

    Equal vectors are one class with a count. Centres are fitted on a bounded sample
    of ``SAMPLE`` classes; every class reaches each shard whose centre is nearly as
    close as its closest (``MARGIN``): in the closest ``MAX_SHARDS`` it is a node, so
    shards overlap, all others it visits with its question. Each shard gets a flat
    graph by robust pruning, the adjacency lists of a class are united over its
    shards, and every class walks its home shard and those it visits: beam search
    from the medoid and its own node, then expansion over all nodes in range. A shard
    of more than ``BLOCK_VECTORS`` nodes is dealt into blocks that are asked one by
    one, those who ask into parts of about ``ASK_VECTORS``. Cosines decide; what the
    search misses is the only loss. The audit holds ``audit`` sampled classes against
    all vectors; when their mean recall is below ``LEAST_RECALL`` the search is
    repeated with a wider margin and beam, up to the margin within which no shard of
    a linked vector is missed, and only then it raises.

    A null key is a row of its own: it has links, but no component's id can be null
    unless all its keys are. Repeated rows link with each other.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = written(
        arrow_map(
            vectors.select(key, vector),
            partial(_classes, key=key, vector=vector),
            f"`{key}` {kind}, size int, cls bigint, vec binary",
        )
    )
    classes = written(
        rows.filter("cls is not null")
        .groupBy("cls")
        .agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("vec").alias("vec"))
    )
    sizes = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vectors.sparkSession
    pairs = spark.createDataFrame([], "a bigint, b bigint")
    for size, n in sorted(sizes.items()):
        some = classes.filter(F.col("size") == size)
        pairs = pairs.unionByName(_widened(some, n, threshold, audit, size))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = classes.select("cls", "n")
    others = (
        both.join(counts.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("_far"))
    )
    of_class = (
        counts.join(others, "cls", "left")
        .join(components(pairs).withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "cls",
            (F.col("n") - 1 + F.coalesce("_far", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cls").alias("component"),
        )
    )
    named = rows.select(key, "cls").join(of_class, "cls", "left")
    smallest = named.filter("component is not null").groupBy("component").agg(F.min(key).alias("_least"))
    component_id = F.when(F.col("component").isNull(), F.col(key)).otherwise(F.col("_least"))
    return named.join(smallest, "component", "left").select(
        key,
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component_id.alias("component_id"),
        F.col(key).eqNullSafe(component_id).alias("kept"),
    )
