"""The scored catalog as users see it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.functions import scalars as S
from cultiva.operators.filters import catalog_preset, catalog_search
from cultiva.operators.joins import overlay
from cultiva.operators.ranking import page

FEATURED = 6
PAGE = 80


def load_catalog(base: DataFrame, hybrid: DataFrame | None = None) -> DataFrame:
    """Predictions with newer ones laid over them, phylum and uncultured flag."""
    merged = overlay(base, hybrid) if hybrid is not None else base
    if "pred_oxygen_requirement_source" not in merged.columns:
        merged = merged.withColumn("pred_oxygen_requirement_source", F.lit("tabular"))
    return merged.withColumns(
        {
            "phylum": S.phylum(F.col("gtdb_taxonomy")),
            "truly_uncultured": S.truly_uncultured(F.col("ncbi_organism_name")),
        }
    )


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """Display columns with their roundings and defaults."""

    def col(name: str) -> F.Column:
        return F.col(name) if name in catalog.columns else F.lit(None)

    accession = S.safe_text(F.col("genome_accession"), "—")
    shown = [
        accession.alias("accession"),
        F.coalesce(F.nullif(S.safe_text(F.col("ncbi_organism_name")), F.lit("")), accession).alias("name"),
        S.safe_text(F.col("phylum"), "—").alias("phylum"),
        S.safe_float(F.col("checkm_completeness"), 1).alias("completeness"),
        F.col("truly_uncultured"),
        S.safe_float(F.col("pred_optimal_temperature_c"), 1).alias("T_opt"),
        S.safe_float(F.col("pred_optimal_ph"), 2).alias("pH"),
        S.safe_text(F.col("pred_oxygen_requirement"), "—").alias("O2"),
        S.safe_float(col("pred_oxygen_requirement_confidence"), 3).alias("O2_conf"),
        S.safe_text(col("pred_oxygen_requirement_source"), "tabular").alias("O2_source"),
        S.safe_float(F.col("pred_salt_tolerance_pct"), 2).alias("salt"),
        S.safe_text(F.col("top1_medium_id"), "—").alias("top_medium_id"),
        S.safe_text(F.col("top1_medium_name"), "—").alias("top_medium_name"),
        S.safe_float(F.col("top1_confidence"), 4).alias("top_confidence"),
    ]
    for i in (2, 3):
        shown += [
            S.safe_text(col(f"top{i}_medium_id")).alias(f"top{i}_medium_id"),
            S.safe_text(col(f"top{i}_medium_name")).alias(f"top{i}_medium_name"),
            S.safe_float(col(f"top{i}_confidence"), 4, None).alias(f"top{i}_confidence"),
        ]
    return catalog.select(*shown)


def with_bands(catalog: DataFrame) -> DataFrame:
    """Temperature, pH and salt classes of the colour scale."""
    return catalog.withColumns(
        {
            "temperature_band": S.temperature_band(F.col("pred_optimal_temperature_c")),
            "ph_band": S.ph_band(F.col("pred_optimal_ph")),
            "salt_band": S.salt_band(F.col("pred_salt_tolerance_pct")),
        }
    )


def browse(
    catalog: DataFrame,
    preset: str = "all",
    search: str = "",
    uncultured_only: bool = False,
    limit: int | None = FEATURED + PAGE,
    offset: int = 0,
) -> DataFrame:
    """Filtered catalog by falling confidence; the first six rows are featured."""
    chosen = catalog_search(catalog_preset(catalog, preset), search)
    if uncultured_only:
        chosen = chosen.filter("truly_uncultured")
    return page(
        chosen, [F.col("top1_confidence").desc_nulls_last(), "genome_accession"], limit, offset
    )
