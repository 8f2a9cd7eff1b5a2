"""Row and column selections. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import empty_to_null, strict_double


def _any(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)


def training_ready(
    df: DataFrame,
    require: str = "any",
    labels: Sequence[str] = tuple(values.PHENOTYPE_TARGETS),
    accession: str = "genome_accession",
) -> DataFrame:
    """Rows with a genome and the required label (or any of ``labels``)."""
    labelled = _any(F.col(c).isNotNull() for c in labels) if require == "any" else F.col(
        require
    ).isNotNull()
    return df.filter(F.col(accession).isNotNull() & labelled)


def gap_species(
    df: DataFrame,
    labels: Sequence[str] = tuple(values.PHENOTYPE_TARGETS),
    accession: str = "genome_accession",
    species: str = "species",
) -> DataFrame:
    """Distinct two-word species names that have a label but no genome."""
    return (
        df.filter(
            F.col(accession).isNull()
            & _any(F.col(c).isNotNull() for c in labels)
            & F.col(species).contains(" ")
        )
        .select(species)
        .distinct()
    )


def quality_filter(df: DataFrame, minimum: float = 90.0) -> DataFrame:
    """Representative genomes of at least ``minimum`` percent completeness."""
    completeness = strict_double(F.col("checkm_completeness").cast("string"))
    return df.filter((F.col("gtdb_representative") == "t") & (completeness >= minimum))


def significant_hits(hits: DataFrame, max_evalue: float = values.MAX_EVALUE) -> DataFrame:
    return hits.filter(F.col("evalue") <= max_evalue)


def ko_hits(
    hits: DataFrame, thresholds: DataFrame, max_evalue: float = values.MAX_EVALUE
) -> DataFrame:
    """Hits that reach the score threshold of their profile (0 when unknown)."""
    known = thresholds.withColumnRenamed("ko", "profile")
    return (
        significant_hits(hits, max_evalue)
        .join(known, "profile", "left")
        .filter(F.col("score") >= F.coalesce(F.col("threshold"), F.lit(0.0)))
        .drop("threshold")
    )


def _presets() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "thermo": F.col("pred_optimal_temperature_c") > 55,
        "psychro": F.col("pred_optimal_temperature_c") < 15,
        "anaerobe": F.lower(F.col("pred_oxygen_requirement")).contains("anaerobe"),
        "halo": F.col("pred_salt_tolerance_pct") > 3,
    }


def catalog_preset(df: DataFrame, name: str) -> DataFrame:
    """Named catalog selections: all, thermo, psychro, anaerobe, halo."""
    presets = _presets()
    if name not in presets:
        raise ValueError(f"unknown preset: {name}")
    return df.filter(presets[name])


def preset_counts(df: DataFrame, value: str, into: str) -> DataFrame:
    """``(preset, n, into)``: genomes of every preset and their largest ``value``, in one pass."""
    presets = _presets()
    row = df.agg(
        *[
            F.struct(F.lit(name).alias("preset"), F.count_if(test).alias("n"), F.max(F.when(test, F.col(value))).alias(into)).alias(name)
            for name, test in presets.items()
        ]
    )
    return row.select(F.inline(F.array(*[F.col(name) for name in presets])))


def catalog_search(
    df: DataFrame,
    text: str,
    columns: Sequence[str] = ("ncbi_organism_name", "genome_accession"),
) -> DataFrame:
    """Case-insensitive substring search over ``columns``; empty text keeps all."""
    if not text:
        return df
    wanted = F.lower(F.lit(text))
    return df.filter(_any(F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False)) for c in columns))


def require_labels(manifest: DataFrame, labels: Iterable[str]) -> DataFrame:
    """Manifest rows that carry every one of the named labels."""
    tests = {
        "temperature": F.col("optimal_temperature_c").isNotNull(),
        "ph": F.col("optimal_ph").isNotNull(),
        "salt": F.col("salt_tolerance_pct").isNotNull(),
        "oxygen": empty_to_null(F.col("oxygen_requirement")).isNotNull(),
        "medium": F.col("n_true_media") > 0,
    }
    for label in labels:
        manifest = manifest.filter(tests[label])
    return manifest


def trainable_targets(
    df: DataFrame, targets: Sequence[str], minimum: int = 100
) -> list[str]:
    """Targets with at least ``minimum`` labelled rows. Runs one aggregate."""
    present = [t for t in targets if t in df.columns]
    if not present:
        return []
    counts = df.agg(*[F.count(t).alias(t) for t in present]).first()
    return [t for t in present if counts[t] >= minimum]


def drop_leaky(columns: Sequence[str], target: str, prefix: str = "md_") -> list[str]:
    """Feature names without those derived from the same media as a weak label."""
    if target not in ("optimal_ph", "salt_tolerance_pct"):
        return list(columns)
    return [c for c in columns if not c.startswith(prefix)]
