"""Exact ordered statistics that never put a whole group into one task.

A window ordered inside a group is one task per group, which fails as soon as a
group holds a large share of the table. Here rows are first reduced to distinct
``(group, value)`` pairs, range-partitioned on both, and the partition totals
(at most one row per group and partition) carry the running sums across
partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cultiva.session import materialize


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    terms = [left[n].eqNullSafe(right[n]) for n in names]
    return reduce(lambda a, b: a & b, terms)


def prefix_sums(
    rows: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    sums: Sequence[str],
    suffix: str = "_before",
    descending: bool = False,
) -> DataFrame:
    """Running sum of the *preceding* rows within each group.

    ``rows`` must be unique on ``keys + order_by``; a column expression in ``order_by``
    brings its own direction. For every column of ``sums``
    a column with ``suffix`` is added that excludes the row itself.
    """
    keys = list(keys)

    def directed(c: str | Column) -> Column:
        if isinstance(c, str):
            return F.col(c).desc() if descending else F.col(c).asc()
        return c

    ordering = [directed(c) for c in order_by]
    parts = materialize(
        rows.repartitionByRange(*[F.col(k).asc() for k in keys], *ordering).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    across = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # Only groups that continue from an earlier partition carry anything, so this
    # table has fewer rows than there are partitions: safe to broadcast.
    carried = (
        totals.select(
            *keys,
            "_part",
            *[F.sum(s).over(across).alias(f"_carry_{s}") for s in sums],
        )
        .filter(F.col(f"_carry_{sums[0]}").isNotNull())
    )
    within = W.partitionBy(*keys, "_part").orderBy(*ordering).rowsBetween(W.unboundedPreceding, -1)
    local = parts.withColumns(
        {f"_local_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}
    )
    joined = local.join(
        F.broadcast(carried), _same(local, carried, [*keys, "_part"]), "left"
    )
    return joined.select(
        *[local[c] for c in rows.columns],
        *[
            (local[f"_local_{s}"] + F.coalesce(carried[f"_carry_{s}"], F.lit(0))).alias(
                f"{s}{suffix}"
            )
            for s in sums
        ],
    )


def row_index(
    df: DataFrame, order_by: Sequence[str | Column], into: str = "row_index", total: str | None = None
) -> DataFrame:
    """Consecutive numbers from 0 in the order of the unique key ``order_by``."""
    counted = prefix_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [], order_by, ["_one"])
    indexed = counted.withColumnRenamed("_one_before", into).drop("_one")
    if total is not None:
        indexed = indexed.withColumn(total, df.agg(F.count(F.lit(1))).scalar())
    return indexed


def fractional_ranks(
    df: DataFrame, keys: Sequence[str], value: str, into: str = "rank"
) -> DataFrame:
    """``(keys, value, n, rank)``: ranks from 1 with ties averaged."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, keys, [value], ["n"])
    return ranked.select(
        *keys, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(into)
    )


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group with linear interpolation; NULL values are ignored.

    The result has ``keys`` and one column per entry of ``quantiles``.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = prefix_sums(counts, keys, [value], ["_n"])
    if keys:
        sizes = ordered.groupBy(*keys).agg(F.sum("_n").alias("_size"))
        sized = ordered.join(sizes, _same(ordered, sizes, keys)).select(
            ordered["*"], sizes["_size"]
        )
    else:
        sized = ordered.withColumn("_size", ordered.agg(F.sum("_n")).scalar())

    def at(position: Column) -> Column:
        inside = (F.col("_n_before") <= position) & (
            position < F.col("_n_before") + F.col("_n")
        )
        return F.max(F.when(inside, F.col(value)))

    picked, result = [], []
    for i, (name, q) in enumerate(quantiles.items()):
        spot = F.lit(float(q)) * (F.col("_size") - 1)
        picked += [
            at(F.floor(spot)).alias(f"_lo{i}"),
            at(F.ceil(spot)).alias(f"_hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"_w{i}"),
        ]
        low, high, weight = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
        result.append((low + (high - low) * weight).alias(name))
    return sized.groupBy(*keys).agg(*picked).select(*keys, *result)
