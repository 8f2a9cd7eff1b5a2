"""Flat tables out of nested documents. No shuffles: every row stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.functions import documents as D
from cultiva.functions.scalars import host_kingdom, medium_id_from_link, parse_year, to_float

TAXONOMY = "Name and taxonomic classification"
CULTURE = "Culture and growth conditions"
PHYSIOLOGY = "Physiology and metabolism"
ISOLATION = "Isolation, sampling and environmental information"


def extract_phenotypes(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Thirteen-column phenotype table of strain documents.

    Every list is read once, into typed structs; what the columns test and parse
    afterwards are plain strings.
    """
    d = F.col(doc)
    levels = {f"isolation_cat{level}": f"Cat{level}" for level in (1, 2, 3)}
    schema = ", ".join(f"`{level}` variant" for level in levels.values())
    sources = docs.withColumn("_sources", D.entries_at(d, schema, ISOLATION, "isolation source categories"))
    return sources.select(
        F.try_variant_get(d, D.path("General", "BacDive-ID"), "bigint").alias("bacdive_id"),
        D.text(d, TAXONOMY, "species").alias("species"),
        D.text(d, TAXONOMY, "genus").alias("genus"),
        F.coalesce(D.truthy(d, TAXONOMY, "LPSN", "family"), D.text(d, TAXONOMY, "family")).alias("family"),
        D.first_tax_id(d, "General", "NCBI tax id").alias("ncbi_taxon_id"),
        D.derive_optimum(d, CULTURE, "culture temp", key="temperature").alias("optimal_temperature_c"),
        D.derive_optimum(d, CULTURE, "culture pH", key="pH").alias("optimal_ph"),
        D.first_value(d, PHYSIOLOGY, "oxygen tolerance", key="oxygen tolerance").alias("oxygen_requirement"),
        D.derive_salt(d, PHYSIOLOGY, "halophily").alias("salt_tolerance_pct"),
        D.first_genome_accession(d, "Sequence information", "Genome sequences").alias("genome_accession"),
        *[D.isolation_categories(F.col("_sources"), level).alias(name) for name, level in levels.items()],
    )


def strain_media_links(docs: DataFrame, doc: str = "doc", key: str = "bacdive_id") -> DataFrame:
    """One row per strain and linked medium; links without a medium id are dropped."""
    link = F.explode(D.list_at(F.col(doc), CULTURE, "culture medium")).alias("_link")
    links = docs.select(key, link)
    entry = F.col("_link")
    return links.select(
        key,
        medium_id_from_link(D.text(entry, "link")).alias("medium_id"),
        D.text(entry, "name").alias("medium_name"),
        F.lower(F.trim(F.coalesce(D.text(entry, "growth"), F.lit("")))).alias("growth"),
    ).filter(F.col("medium_id").isNotNull())


def normalize_recipes(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per compound of a medium recipe, including those without amount."""
    d = F.col(doc)
    solutions = docs.select(
        F.coalesce(D.text(d, "medium", "id"), F.lit("")).alias("medium_id"),
        F.explode(D.list_at(d, "solutions")).alias("_solution"),
    )
    s = F.col("_solution")
    items = solutions.select(
        "medium_id",
        F.coalesce(D.text(s, "name"), F.lit("")).alias("solution_name"),
        F.explode(D.list_at(s, "recipe")).alias("_item"),
    )
    i = F.col("_item")
    return items.select(
        "medium_id",
        "solution_name",
        F.try_variant_get(i, "$.compound_id", "bigint").alias("compound_id"),
        D.truthy(i, "compound").alias("compound"),
        F.try_variant_get(i, "$.amount", "double").alias("amount"),
        D.text(i, "unit").alias("unit"),
        F.try_variant_get(i, "$.g_l", "double").alias("g_l"),
        F.coalesce(F.try_variant_get(i, "$.optional", "int"), F.lit(0)).alias("optional"),
        D.text(i, "condition").alias("condition"),
    ).filter(F.col("compound").isNotNull())


def medium_metadata(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per medium document."""
    d = F.col(doc)
    return docs.select(
        D.text(d, "medium", "id").alias("medium_id"),
        D.text(d, "medium", "name").alias("name"),
        F.try_variant_get(d, "$.medium.complex_medium", "int").alias("complex_medium"),
        F.try_variant_get(d, "$.medium.min_pH", "double").alias("min_pH"),
        F.try_variant_get(d, "$.medium.max_pH", "double").alias("max_pH"),
        D.text(d, "medium", "source").alias("source"),
        D.text(d, "medium", "link").alias("link"),
        F.size(D.list_at(d, "solutions")).alias("n_solutions"),
    )


def parse_isolation(docs: DataFrame, doc: str = "doc", key: str = "bacdive_id") -> DataFrame:
    """First isolation record of a strain as typed columns."""
    first = docs.select(
        key, F.get(D.list_at(F.col(doc), ISOLATION, "isolation"), F.lit(0)).alias("_iso")
    )
    i = F.col("_iso")
    return first.select(
        key,
        D.only_text(i, "country").alias("iso_country"),
        D.only_text(i, "continent").alias("iso_continent"),
        F.try_variant_get(i, "$.latitude", "double").alias("iso_lat"),
        F.try_variant_get(i, "$.longitude", "double").alias("iso_lon"),
        F.coalesce(
            parse_year(D.only_text(i, "sampling date")),
            parse_year(D.only_text(i, "isolation date")),
        ).alias("iso_collection_year"),
        D.only_text(i, "host species").alias("iso_host_species"),
        F.coalesce(
            D.let(D.only_text(i, "host species"), host_kingdom),
            D.let(D.only_text(i, "sample type"), host_kingdom),
        ).alias("iso_host_kingdom"),
        D.only_text(i, "sample type").alias("iso_sample_text"),
        D.only_text(i, "geographic location").alias("iso_geographic_location"),
    )


def parse_measurement(df: DataFrame, text: str, into: str) -> DataFrame:
    return df.withColumn(into, to_float(F.col(text)))
