"""Leakage-free fold assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cultiva.functions.scalars import draw
from cultiva.operators.ordered import row_index


def dealing_plan(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """``(size, first, n, turn)``: where groups of each size go.

    ``sizes`` lists ``(size, number of groups)``. Groups go, largest first, to the
    fold with the fewest rows so far, the lower fold number when equal. Groups
    ``first`` to ``first + n - 1`` of a size are dealt to the folds of ``turn`` again
    and again. Equal groups are dealt in whole rounds at once: the lowest folds whose
    loads lie less than a group apart take turns until they reach the next fold, so
    there are at most about as many rows as folds per distinct size.
    """
    load = [0] * folds
    plan = []
    for size, groups in sorted(sizes, reverse=True):
        first = 0
        while first < groups:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            low = [f for f in order if load[f] < load[order[0]] + size]
            if len(low) == folds:
                n = groups - first
            else:
                above = load[order[len(low)]]
                rounds = -(-(above - load[low[-1]]) // size)
                n = min(groups - first, rounds * len(low))
            plan.append((size, first, n, low))
            for i, fold in enumerate(low):
                load[fold] += size * (n // len(low) + (i < n % len(low)))
            first += n
    return plan


def fold_of_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """``(group, fold)``: every group in one fold, fold sizes balanced.

    Groups go, largest first and equal sizes by name, to the fold with the
    fewest rows so far (the lower fold number when equal); there are no more folds
    than groups, but two at least. Only the distinct group sizes with their numbers
    of groups reach the driver, fewer than the square root of twice the rows.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.groupBy("_n").agg(F.count(F.lit(1)).alias("groups")).collect()
    sizes = [(row["_n"], row["groups"]) for row in rows]
    folds = min(k, max(2, sum(n for _, n in sizes)))
    plan = dealing_plan(sizes, folds)
    before, start = 0, {}
    for size, n in sorted(sizes, reverse=True):
        start[size] = before
        before += n
    dealt = df.sparkSession.createDataFrame(
        [(size, start[size] + first, start[size] + first + n, turn) for size, first, n, turn in plan],
        "_size bigint, _from bigint, _to bigint, _turn array<int>",
    )
    name = F.coalesce(F.col(group).cast("string"), F.lit("None"))
    numbered = row_index(
        counts.withColumns({"_neg": -F.col("_n"), "_name": name, "_none": F.col(group).isNull()}),
        ["_neg", "_name", "_none"],
        into="_i",
    )
    inside = (F.col("_n") == F.col("_size")) & (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to"))
    turn = (F.col("_i") - F.col("_from")) % F.size("_turn")
    return numbered.join(dealt, inside).select(group, F.get("_turn", turn.cast("int")).alias("fold"))


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Add ``fold`` such that no group spans two folds."""
    folds = fold_of_groups(df, group, k)
    named = folds.select(F.col(group).alias("_group"), "fold")
    return df.join(named, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def random_fold(key: Column, k: int, seed: int = 0) -> Column:
    """Fold from a hash of the key: independent of order and partitioning."""
    return F.pmod(F.conv(F.substring(draw([key], seed), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")
