"""Scans of tab-separated and flat-file annotation formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva.functions.scalars import empty_to_null, strict_double

GENOME_METADATA = (
    "accession",
    "gtdb_representative",
    "gtdb_taxonomy",
    "ncbi_genbank_assembly_accession",
    "ncbi_organism_name",
    "checkm_completeness",
    "ncbi_assembly_level",
)


def scan_genome_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Seven text columns of a (possibly gzipped) tab-separated metadata table."""
    table = spark.read.option("sep", "\t").option("header", True).csv(path)
    return table.select(*[c for c in GENOME_METADATA if c in table.columns])


def _entry(record: Column, name: str, continued: bool) -> Column:
    """Text of one field; continuation lines start with a blank."""
    tail = r"[^\n]*(?:\n [^\n]*)*" if continued else r"[^\n]*"
    raw = F.regexp_extract(record, rf"(?:^|\n){name}({tail})", 1)
    return F.trim(F.regexp_replace(raw, r"\s*\n\s*", " "))


def parse_modules(records: DataFrame, text: str = "value") -> DataFrame:
    """Module rows from flat-file records; those without a definition are dropped."""
    record = F.regexp_replace(F.col(text), "\r", "")
    definition = _entry(record, "DEFINITION", True)
    return records.select(
        F.regexp_extract(record, r"(?:^|\n)ENTRY\s+(\S+)", 1).alias("id"),
        _entry(record, "NAME", False).alias("name"),
        definition.alias("definition"),
        F.array_sort(
            F.array_distinct(F.regexp_extract_all(definition, F.lit(r"(K\d{5})"), 1))
        ).alias("ko_list"),
        _entry(record, "CLASS", True).alias("category"),
    ).filter(F.col("definition") != "")


def scan_modules(spark: SparkSession, path: str) -> DataFrame:
    """Module flat file, records ended by ``///``."""
    return parse_modules(spark.read.option("lineSep", "///").text(path))


def ko_thresholds(table: DataFrame) -> DataFrame:
    """``(ko, threshold)``; thresholds that are not numbers count as zero."""
    return table.select(
        F.col("ko").cast("string"),
        F.coalesce(strict_double(F.col("threshold").cast("string")), F.lit(0.0)).alias("threshold"),
    )


def scan_ko_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return ko_thresholds(spark.read.option("sep", "\t").option("header", True).csv(path))


TRAITS = (
    ("temperature_optimum", "value", "external_temperature_c"),
    ("temperature_optimum", "error", "external_temperature_error"),
    ("ph_optimum", "value", "external_ph"),
    ("ph_optimum", "error", "external_ph_error"),
    ("salinity_optimum", "value", "external_salt_pct"),
    ("salinity_optimum", "error", "external_salt_error"),
    ("oxygen", "error", "external_oxygen_probability"),
)


def flatten_traits(rows: DataFrame, genome: str = "genome_accession") -> DataFrame:
    """``(genome, condition, value, error)`` text rows to one row per genome."""

    def cell(condition: str, column: str) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col(column)))

    return rows.groupBy(genome).agg(
        *[strict_double(cell(c, column)).alias(name) for c, column, name in TRAITS],
        F.coalesce(empty_to_null(cell("oxygen", "value")), F.lit("")).alias("external_oxygen"),
    )


def scan_trait_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One tab-separated file per genome: condition, value, error."""
    rows = (
        spark.read.option("sep", "\t")
        .option("header", True)
        .schema("condition string, value string, error string")
        .option("enforceSchema", True)
        .csv(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+(?:\.\d+)?)", 1).alias(
                "genome_accession"
            ),
            "condition",
            "value",
            "error",
        )
    )
    return flatten_traits(rows)
