"""Recommendations for any number of genomes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.operators.joins import with_medium_name
from cultiva.operators.ranking import recipe_summary
from cultiva.plans.boosting import Ensemble, with_scores
from cultiva.plans.phenotype import Heads, predict_targets


def recommend_media(
    genomes: DataFrame,
    models: Ensemble,
    names: DataFrame,
    recipes: DataFrame,
    top_k: int = 8,
    key: str = "genome_accession",
) -> DataFrame:
    """Best media per genome with name, confidence and a short recipe.

    Scores are ranked within their row, equal ones by medium id; only the best
    ``top_k`` leave it.
    """
    own = genomes.select(key, *[F.col(f"`{f}`") for f in models.features if f != key])
    entries = [
        F.struct((-F.bround(F.get("_scores", F.lit(i)), 4)).alias("negated"), F.lit(m.name).alias("medium_id"))
        for i, m in enumerate(models.models)
    ]
    best = F.slice(F.array_sort(F.array(*entries)), 1, top_k)
    ranked = with_scores(own, models).select(key, F.posexplode(best).alias("_at", "_best")).select(
        key, (F.col("_at") + 1).alias("rank"), "_best.medium_id", (-F.col("_best.negated")).alias("score")
    )
    named = with_medium_name(ranked, names).join(recipe_summary(recipes), "medium_id", "left")
    return named.select(
        key, "rank", "medium_id", F.col("medium_name").alias("name"),
        F.col("score").alias("confidence"), F.coalesce("recipe", F.lit("")).alias("recipe"),
    )


def describe_genomes(
    genomes: DataFrame, features: Sequence[str], heads: Heads, key: str = "genome_accession"
) -> DataFrame:
    """Size summary and predicted phenotypes of genomes."""
    return predict_targets(
        genomes, features, heads, [key, "n_contigs", "n_predicted_cds", "gc_content"]
    ).withColumns(
        {
            "n_contigs": F.col("n_contigs").cast("bigint"),
            "n_predicted_cds": F.col("n_predicted_cds").cast("bigint"),
            "gc_content": F.bround("gc_content", 4),
        }
    )
