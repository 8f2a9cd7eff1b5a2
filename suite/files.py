"""Files: tables are written to the scratch folder and read by the library's scans."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from cultiva.session import shared_scratch
from cultiva.sources.annotations import scan_modules, scan_trait_predictions
from cultiva.sources.documents import scan_documents
from cultiva.sources.sequences import scan_fasta, write_fasta
from suite.base import REGISTRY, query, spread, table
from suite.rules import module_records


@query(
    "fasta_files",
    r"""SELECT source || '.1' AS genome_accession, 'doc' || doc_id AS contig_id,
  md5(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', '', 'g')) AS hash FROM documents""",
)
def fasta_files(spark, folder):
    """Contigs of all genomes as compressed files and back."""
    place = f"{shared_scratch(spark)}/fasta"
    contigs = table(spark, folder, "documents").select(
        F.concat("source", F.lit(".1")).alias("genome_accession"),
        F.concat(F.lit("doc"), "doc_id").alias("contig_id"),
        F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"),
    )
    write_fasta(contigs, place)
    return scan_fasta(spark, place).select(
        "genome_accession", "contig_id", F.md5(F.regexp_replace("seq", "[^A-Z]", "")).alias("hash")
    )


@query("module_files", REGISTRY["module_flatfile"].sql)
def module_files(spark, folder):
    """Module records in a flat file, each ended by its own mark."""
    place = f"{shared_scratch(spark)}/modules"
    module_records(spark, folder).select(F.concat("value", F.lit("///")).alias("value")).write.text(place)
    rows = scan_modules(spark, place)
    return rows.withColumn("ko_list", F.array_join("ko_list", "|"))


def one_file_each(rows, place, suffix):
    """``name`` and ``value`` as files ``name.suffix`` below ``place``, written by the tasks.

    ``place`` is a folder on a storage that pyarrow reaches too. A task that runs again
    writes the same files again.
    """

    def write(part):
        store, folder = FileSystem.from_uri(place)
        for row in part:
            with store.open_output_stream(f"{folder}/{row['name']}.{suffix}") as file:
                file.write(f"{row['value']}\n".encode())

    store, folder = FileSystem.from_uri(place)
    store.create_dir(folder)
    spread(rows, "name").foreachPartition(write)


@query(
    "trait_prediction_files",
    """SELECT 'GCA_' || lpad(s_suppkey::varchar, 9, '0') || '.1' AS genome_accession, (s_suppkey % 60 + 0.5)::double AS external_temperature_c,
  CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 14) / 2.0::double END AS external_ph, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'tolerant' END AS external_oxygen
FROM supplier""",
)
def trait_prediction_files(spark, folder):
    """One tab-separated file per supplier, written and scanned."""
    place = f"{shared_scratch(spark)}/traits"
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(
        F.concat(F.lit("GCA_"), F.lpad(k.cast("string"), 9, "0"), F.lit(".1")).alias("name"),
        F.concat_ws(
            "\n", F.lit("\tvalue\terror"), F.concat(F.lit("temperature_optimum\t"), (k % 60 + 0.5).cast("string"), F.lit("\t1.5")),
            F.concat(F.lit("ph_optimum\t"), F.when(k % 3 != 0, ((k % 14) / 2).cast("string")).otherwise(""), F.lit("\t0.25")),
            F.concat(F.lit("oxygen\t"), F.when(k % 5 != 0, "tolerant").otherwise(""), F.lit("\t0.9")),
        ).alias("value"),
    )
    one_file_each(rows, place, "tsv")
    return scan_trait_predictions(spark, place).select(
        "genome_accession", "external_temperature_c", "external_ph", "external_oxygen"
    )


@query(
    "document_files",
    """SELECT s_suppkey AS bacdive_id, 'G' || (s_suppkey % 7) AS genus FROM supplier WHERE s_suppkey % 10 NOT IN (3, 7)""",
)
def document_files(spark, folder):
    """One JSON file per supplier; broken ones and names that are no numbers are skipped."""
    place = f"{shared_scratch(spark)}/documents"
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(
        F.when(k % 10 == 3, F.concat(F.lit("note"), k)).otherwise(k.cast("string")).alias("name"),
        F.concat(
            F.lit('{"Name and taxonomic classification": {"genus": "G'), k % 7, F.when(k % 10 == 7, '"}').otherwise('"}}')
        ).alias("value"),
    )
    one_file_each(rows, place, "json")
    genus = F.try_variant_get("doc", "$['Name and taxonomic classification'].genus", "string")
    return scan_documents(spark, place).select("bacdive_id", genus.alias("genus"))
