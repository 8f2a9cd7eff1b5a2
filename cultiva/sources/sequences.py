"""FASTA scan and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENOME_FOLDER = r"/genome_accession=([^/]+)/[^/]*$"
GENOME_FILE = r"^(.*?)\.(?:fna|fa|fasta)(?:\.gz)?$"


def parse_fasta_records(records: DataFrame, text: str = "value") -> DataFrame:
    """Turn ``>id description`` records into ``contig_id`` and ``seq``.

    The id is the first word of the header. Sequence lines are joined without
    white space and upper-cased.
    """
    record = F.regexp_replace(F.col(text), r"^\s*>", "")
    header = F.substring_index(record, "\n", 1)
    contig_id = F.split(F.trim(F.regexp_replace(header, r"\r", "")), r"\s+")[0]
    body = F.when(record.contains("\n"), F.substring(record, F.length(header) + 2, F.length(record)))
    return (
        records.withColumn("contig_id", contig_id)
        .withColumn("seq", F.upper(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", "")))
        .filter(F.trim(F.regexp_replace(record, r"\s+", " ")) != "")
        .drop(text)
    )


def genome_of_file() -> Column:
    """Genome of the file a row was read from: its partition folder, else its name without suffix."""
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), GENOME_FOLDER, 1))
    return F.coalesce(F.nullif(folder, F.lit("")), F.regexp_extract(F.col("_metadata.file_name"), GENOME_FILE, 1))


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per contig.

    The genome is the partition folder that :func:`write_fasta` makes, else the file
    name without its suffix. Plain files are split across tasks at record starts; ``.gz`` files are
    readable but not splittable.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(genome_of_file().alias("genome_accession"), "value")
    return parse_fasta_records(records)


def fasta_text(contig_id: Column, seq: Column, width: int = 80) -> Column:
    """Header line plus sequence wrapped at ``width`` characters."""
    wrapped = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), contig_id, F.lit("\n"), wrapped)


def write_fasta(contigs: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write contigs as FASTA, one sub-folder per genome."""
    contigs.select(
        "genome_accession", fasta_text(F.col("contig_id"), F.col("seq")).alias("value")
    ).write.mode("overwrite").option("compression", compression).partitionBy(
        "genome_accession"
    ).text(path)
