"""Top-k, de-duplication and sampling.

``row_number() <= k`` lets Spark keep only k rows per group before the shuffle,
so a group of any size sends k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import draw
from cultiva.operators.ordered import row_index


def _columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order_by]


def top_k(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], k: int, into: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group with their rank from 1."""
    ordering = W.partitionBy(*keys).orderBy(*_columns(order_by))
    return df.withColumn(into, F.row_number().over(ordering)).filter(F.col(into) <= k)


def keep_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]
) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_k(df, keys, order_by, 1, "_keep").drop("_keep")


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the last in the given order."""
    return keep_first(df, keys, [F.col(o).desc() for o in order_by])


def rank_media(
    scores: DataFrame, k: int, key: str = "genome_accession", digits: int | None = None
) -> DataFrame:
    """Best ``k`` media per genome, equal scores by medium id."""
    if digits is not None:
        scores = scores.withColumn("score", F.bround("score", digits))
    return top_k(scores, [key], [F.col("score").desc(), "medium_id"], k)


def top_media_wide(
    scores: DataFrame,
    names: DataFrame,
    k: int = 3,
    key: str = "genome_accession",
) -> DataFrame:
    """``top1..topk`` medium id, name and confidence, one row per genome."""
    ranked = rank_media(scores, k, key).join(
        names.select("medium_id", F.col("name").alias("_name")), "medium_id", "left"
    )

    def at(i: int, column: Column) -> Column:
        return F.max(F.when(F.col("rank") == i, column))

    cells = []
    for i in range(1, k + 1):
        cells += [
            at(i, F.col("medium_id")).alias(f"top{i}_medium_id"),
            at(i, F.coalesce("_name", F.lit("(unknown)"))).alias(f"top{i}_medium_name"),
            at(i, F.col("score").cast("double")).alias(f"top{i}_confidence"),
        ]
    return ranked.groupBy(key).agg(*cells)


def top_media_from_scores(score_columns: dict[str, str], names: dict[str, str], k: int = 3) -> list[Column]:
    """The same columns from one score column per medium, without any shuffle.

    ``score_columns`` maps medium ids to column names.
    """
    entries = F.array(
        *[
            F.struct((-F.col(c)).alias("negated"), F.lit(m).alias("medium_id"))
            for m, c in score_columns.items()
        ]
    )
    best = F.array_sort(entries)
    pairs = [F.lit(x) for m in score_columns for x in (m, names.get(m, "(unknown)"))]
    lookup = F.create_map(*pairs)
    cells = []
    for i in range(1, k + 1):
        entry = F.get(best, F.lit(i - 1))
        cells += [
            entry["medium_id"].alias(f"top{i}_medium_id"),
            lookup[entry["medium_id"]].alias(f"top{i}_medium_name"),
            (-entry["negated"]).cast("double").alias(f"top{i}_confidence"),
        ]
    return cells


def attach_top_media(predictions: DataFrame, top: DataFrame, key: str = "genome_accession") -> DataFrame:
    """Replace any earlier ``topN_`` columns by the ones of ``top``."""
    stale = [c for c in predictions.columns if c.startswith(("top1_", "top2_", "top3_"))]
    return predictions.drop(*stale).join(top, key, "left")


def shortest_per_category(
    hits: DataFrame,
    proteins: DataFrame,
    k: int = values.MAX_MARKER_PROTEINS,
    max_length: int = values.MAX_PROTEIN_LENGTH,
) -> DataFrame:
    """The ``k`` shortest distinct hit proteins per genome and category.

    ``hits``: genome_accession, protein_idx, category. ``proteins``:
    genome_accession, protein_idx, aa.
    """
    keys = ["genome_accession", "category"]
    distinct = hits.select(*keys, "protein_idx").distinct()
    sized = distinct.join(proteins, ["genome_accession", "protein_idx"])
    kept = top_k(sized, keys, [F.length("aa"), "protein_idx"], k)
    return kept.select(*keys, "rank", "protein_idx", F.substring("aa", 1, max_length).alias("aa"))


def sequences_by_category(kept: DataFrame) -> DataFrame:
    """``by_category`` and ``category_counts`` maps per genome, every category present.

    ``kept`` is bounded (k per category) by :func:`shortest_per_category`.
    """
    per_genome = kept.groupBy("genome_accession").agg(
        F.collect_list(F.struct("category", "rank", "aa")).alias("_all")
    )

    def sequences(category: str) -> Column:
        chosen = F.filter(F.array_sort("_all"), lambda x: x["category"] == category)
        return F.transform(chosen, lambda x: x["aa"])

    sequences_map = F.create_map(
        *[x for c in values.CATEGORIES for x in (F.lit(c), sequences(c))]
    )
    counted = per_genome.select("genome_accession", sequences_map.alias("by_category"))
    return counted.withColumn(
        "category_counts", F.transform_values("by_category", lambda _, v: F.size(v))
    )


def recipe_summary(recipes: DataFrame, k: int = 5) -> DataFrame:
    """``compound amountunit`` of the ``k`` largest compounds per medium."""
    shown = F.when(
        F.col("amount").isNotNull() & F.col("unit").isNotNull(),
        F.concat("compound", F.lit(" "), F.col("amount").cast("string"), "unit"),
    ).otherwise(F.col("compound"))
    order = [F.col("g_l").desc_nulls_last(), "compound", F.col("amount").cast("string"), "unit"]
    ranked = top_k(recipes.withColumn("_text", shown), ["medium_id"], order, k)
    return ranked.groupBy("medium_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "_text"))), lambda x: x["_text"]
            ),
            ", ",
        ).alias("recipe")
    )


def best_assembly(assemblies: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Most complete assembly per key; equal levels keep the given order."""
    levels = [F.lit(x) for pair in values.ASSEMBLY_LEVEL_RANK.items() for x in pair]
    level_rank = F.coalesce(F.create_map(*levels)[F.col("level")], F.lit(values.ASSEMBLY_LEVEL_OTHER))
    return keep_first(assemblies, keys, [level_rank, *order_by])


def top_errors(predictions: DataFrame, n: int = 25, tie: Sequence[str] = ()) -> DataFrame:
    """Most confident wrong predictions.

    Needs ``true_class``, ``pred_class``, ``confidence``, ``true_probability``.
    """
    wrong = predictions.filter(F.col("true_class") != F.col("pred_class"))
    margin = F.bround(F.col("confidence") - F.col("true_probability"), 6)
    shown = wrong.withColumns(
        {
            "margin": margin,
            "confidence": F.bround("confidence", 6),
            "true_probability": F.bround("true_probability", 6),
        }
    )
    return shown.orderBy(F.col("confidence").desc(), F.col("margin").desc(), *tie).limit(n)


def page(df: DataFrame, order_by: Sequence[str | Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a fully ordered table.

    Without a limit an offset is cut off by row number, so the rest of the table
    stays spread over its tasks.
    """
    ordering = _columns(order_by)
    if limit is not None:
        ordered = df.orderBy(*ordering)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    if not offset:
        return df.orderBy(*ordering)
    # Directions are turned into one ascending key, whose ties are rows of their own.
    numbered = row_index(
        df.withColumn("_tie", F.monotonically_increasing_id()), [*ordering, "_tie"], into="_row"
    )
    return numbered.filter(F.col("_row") >= offset).orderBy("_row").drop("_row", "_tie")


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same on every run and partitioning.

    ``key`` must be unique; a sample at least as large as the table is the table.
    """
    numbered = row_index(df.withColumn("_draw", draw(key, seed)), ["_draw", *key], into="_row")
    return numbered.filter(F.col("_row") < n).drop("_row", "_draw")


def sample_genomes(df: DataFrame, n: int, key: Sequence[str], accession: str = "genome_accession", seed: int = 0) -> DataFrame:
    """``n`` accessions with one row each, drawn twice by hash.

    The row of an accession is the one whose ``key`` draws lowest, then accessions are
    drawn like the rows of :func:`sample_n`. Rows without an accession are left out. Only
    the lowest draw of an accession leaves a task, so an accession of very many rows is no burden.
    """
    known = df.filter(F.col(accession).isNotNull())
    place = F.struct(draw(key, seed).alias("draw"), *[F.col(k) for k in key])
    one = known.groupBy(accession).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), place).alias("_one"))
    return sample_n(one.select("_one.*"), n, [accession], seed)
