"""Pooling of per-protein vectors into genome features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions import vectors as V
from cultiva.functions.scalars import draw
from cultiva.operators.joins import with_category
from cultiva.operators.ranking import top_k

GENOME = "genome_accession"


def mean_pool(vectors: DataFrame, keys: Sequence[str], column: str = "embedding") -> DataFrame:
    """Element-wise mean per key: partial sums per task, then one merge."""
    dense = array_to_vector(F.col(column).cast("array<double>"))
    return vectors.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(dense)).alias(column), F.count(F.lit(1)).alias("n")
    )


def mean_pool_all(
    genomes: DataFrame, vectors: DataFrame, length: int, key: str = GENOME, column: str = "embedding"
) -> DataFrame:
    """Mean vector of every genome, zeros for those without vectors."""
    pooled = mean_pool(vectors, [key], column)
    return genomes.select(key).distinct().join(pooled, key, "left").select(
        key,
        F.coalesce(column, V.zeros(length)).alias(column),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def sample_then_pool(
    vectors: DataFrame, n: int, item: str, seed: int = 0, key: str = GENOME, column: str = "embedding"
) -> DataFrame:
    """Mean over ``n`` items per key drawn by hash order, the same on every run."""
    drawn = top_k(vectors, [key], [draw([item], seed), item], n, "_draw")
    return mean_pool(drawn, [key], column)


def categorized_hits(hits: DataFrame) -> DataFrame:
    """Distinct ``(genome, category, protein)`` of marker hits."""
    return with_category(hits).select(GENOME, "category", "protein_idx").distinct()


def pool_per_category(
    genomes: DataFrame,
    hits: DataFrame,
    vectors: DataFrame,
    length: int,
    categories: Sequence[str] = values.CATEGORIES,
) -> DataFrame:
    """``pme_<category>`` vector and count per genome, zeros where nothing was hit.

    ``hits``: genome_accession, category, protein_idx, distinct. ``vectors``:
    genome_accession, protein_idx, embedding.
    """
    embedded = hits.join(vectors, [GENOME, "protein_idx"])
    pooled = mean_pool(embedded, [GENOME, "category"])
    counts = hits.groupBy(GENOME).agg(
        F.count_distinct("protein_idx").alias("pme_marker_proteins_total"),
        *[
            F.count_if(F.col("category") == c).alias(f"pme_{c}_n")
            for c in categories
        ],
    )
    cells = [
        F.max(F.when(F.col("category") == c, F.col("embedding"))).alias(f"pme_{c}")
        for c in categories
    ]
    wide = pooled.groupBy(GENOME).agg(*cells)
    joined = (
        genomes.select(GENOME).distinct().join(counts, GENOME, "left").join(wide, GENOME, "left")
    )
    return joined.select(
        GENOME,
        F.coalesce("pme_marker_proteins_total", F.lit(0)).alias("pme_marker_proteins_total"),
        *[F.coalesce(f"pme_{c}_n", F.lit(0)).alias(f"pme_{c}_n") for c in categories],
        *[F.coalesce(f"pme_{c}", V.zeros(length)).alias(f"pme_{c}") for c in categories],
    )


def concat_categories(
    pooled: DataFrame, categories: Sequence[str] = values.CATEGORIES, into: str = "embedding"
) -> DataFrame:
    """Category vectors joined end to end in fixed order."""
    return pooled.select(GENOME, F.concat(*[F.col(f"pme_{c}") for c in categories]).alias(into))


def classify(
    logits: DataFrame,
    key: str,
    column: str = "logits",
    classes: Sequence[str] = values.OXYGEN_CLASSES,
    target: str = "oxygen_requirement",
    source: str | None = None,
) -> DataFrame:
    """Class, confidence and one probability column per class."""
    scored = logits.select(key, V.softmax(F.col(column)).alias("_p"))
    p = F.col("_p")
    picked = [
        V.class_name(V.argmax(p), classes).alias(f"pred_{target}"),
        F.array_max(p).alias(f"pred_{target}_confidence"),
    ]
    if source is not None:
        picked.append(F.lit(source).alias(f"pred_{target}_source"))
    return scored.select(
        key,
        *picked,
        *[F.get(p, F.lit(i)).alias(f"pred_{target}_prob_{c}") for i, c in enumerate(classes)],
    )
