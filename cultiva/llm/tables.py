"""Intermediate tables and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.session import Scratch, shared_scratch


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs a task that reads files, not the
    whole job, and both readers of the table see the same rows.
    """
    spark = df.sparkSession
    folder = shared_scratch(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected ``edges``.

    Only nodes that have an edge appear. Alternates the two star operations of
    connected components by map and reduce: each node hands its smallest
    neighbour to its larger (then smaller) neighbours, until nothing changes.
    A node of very many neighbours costs no more than its edges: minima are
    combined before the shuffle, and the join back is split when it is skewed. The
    pairs of a round are deleted once those of the next one are written.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.written(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("u < v").distinct()
    )
    total = _fingerprint(pairs)
    if total[0] == 0:
        return pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
    while True:
        large = _star(pairs, larger=True)
        small = scratch.written(_star(large, larger=False))
        old, pairs = pairs, small
        scratch.delete(old)
        before, total = total, _fingerprint(small)
        if total == before:
            break
    roots = small.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return small.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


def _fingerprint(pairs: DataFrame) -> tuple[int, int]:
    """Number and sum of hashes of pairs: a round that leaves both as they are has changed nothing."""
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")
    ).first()
    return sums["n"], sums["s"]


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step over unique pairs ``u < v``."""
    if larger:
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        linked = both.join(least, "v").filter("u > v").select(F.col("u").alias("x"), "m")
    else:
        least = pairs.groupBy("v").agg(F.min("u").alias("m"))
        joined = pairs.join(least, "v")
        linked = joined.select(F.col("u").alias("x"), "m").unionByName(
            joined.select(F.col("v").alias("x"), "m")
        )
    return linked.filter("x <> m").select(F.col("x").alias("v"), F.col("m").alias("u")).distinct()
