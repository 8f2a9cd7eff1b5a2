"""Registry, table loading and the stand-ins several queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.sequences import ascii_upper


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""

    def register(run):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt over all cores by ``key``: a table of one row group would be one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(*columns)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as the oracles do."""
    return df.select(
        *[
            F.round(F.col(f"`{c}`"), digits).alias(c) if kind in ("double", "float") else F.col(f"`{c}`")
            for c, kind in df.dtypes
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    """Rounded double in the oracle dialect, without negative zero."""
    return f"(round(({expression})::double, {digits}) + 0.0)"


# --- strains: customers, grouped by nation ----------------------------------

STRAINS_SQL = """
strains AS (
  SELECT c_custkey AS bacdive_id,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END AS family,
         CASE WHEN c_custkey % 7 = 0 THEN NULL
              ELSE n_name || ' ' || c_mktsegment || (c_custkey % 3)::varchar END AS genus,
         c_mktsegment || ' ' || (c_custkey % 5)::varchar AS species,
         'GCA_' || lpad((c_custkey % 997)::varchar, 9, '0') AS genome_accession,
         c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def strains(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as strains: nation is the family, some names are missing."""
    key = F.col("c_custkey")
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        key.alias("bacdive_id"),
        F.when(key % 11 != 0, F.col("n_name")).alias("family"),
        F.when(
            key % 7 != 0, F.concat("n_name", F.lit(" "), "c_mktsegment", (key % 3).cast("string"))
        ).alias("genus"),
        F.concat("c_mktsegment", F.lit(" "), (key % 5).cast("string")).alias("species"),
        F.concat(F.lit("GCA_"), F.lpad((key % 997).cast("string"), 9, "0")).alias("genome_accession"),
        "c_acctbal",
    )


# --- links: order lines, a customer grows on a part's brand ------------------

LINKS_SQL = """
links AS (
  SELECT o_custkey AS bacdive_id, p_brand AS medium_id, p_brand || ' agar' AS medium_name,
         CASE WHEN l_quantity >= 46 THEN 'yes' WHEN l_quantity < 5 THEN '' ELSE 'no' END AS growth,
         l_quantity, l_extendedprice, p_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as strain-medium links; large quantities mean growth."""
    quantity = F.col("l_quantity")
    return (
        lines(spark, folder, "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("bacdive_id"),
            F.col("p_brand").alias("medium_id"),
            F.concat("p_brand", F.lit(" agar")).alias("medium_name"),
            F.when(quantity >= 46, "yes").when(quantity < 5, "").otherwise("no").alias("growth"),
            "l_quantity",
            "l_extendedprice",
            "p_partkey",
        )
    )


# --- media: brands -----------------------------------------------------------

MEDIA_SQL = """
media_names AS (
  SELECT p_brand AS medium_id, p_brand || ' agar' AS name FROM part
  WHERE p_brand NOT LIKE '%7' GROUP BY p_brand)
"""


def media_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of most media; ids ending in 7 are left unnamed."""
    brands = table(spark, folder, "part").select("p_brand").distinct()
    return brands.filter(~F.col("p_brand").endswith("7")).select(
        F.col("p_brand").alias("medium_id"), F.concat("p_brand", F.lit(" agar")).alias("name")
    )


# --- genomes: documents of one source ----------------------------------------

GENOME_SQL = """
contigs AS (
  SELECT source AS genome_accession, doc_id AS contig_id,
         translate(text, 'acgt', 'ACGT') AS seq FROM documents),
proteins AS (
  SELECT source AS genome_accession, doc_id AS protein_idx,
         translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS aa,
         translate(text, 'acgt', 'ACGT') AS cds FROM documents)
"""


def upper_nucleotides(text: Column) -> Column:
    """``text`` with a, c, g and t in upper case."""
    for letter in "acgt":
        text = F.replace(text, F.lit(letter), F.lit(letter.upper()))
    return text


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as contigs of the genome named by their source."""
    return spread(table(spark, folder, "documents").select("source", "doc_id", "text"), "doc_id").select(
        F.col("source").alias("genome_accession"),
        F.col("doc_id").alias("contig_id"),
        upper_nucleotides(F.col("text")).alias("seq"),
    )


def proteins(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("source", "doc_id", "text"), "doc_id").select(
        F.col("source").alias("genome_accession"),
        F.col("doc_id").alias("protein_idx"),
        ascii_upper(F.col("text")).alias("aa"),
        upper_nucleotides(F.col("text")).alias("cds"),
    )


# --- marker hits: order lines against suppliers ------------------------------

MARKER_VALUES = ", ".join(
    f"({i}, '{p}', '{m}', '{c}')" for i, (p, m, c) in enumerate(values.marker_rows())
)
HITS_SQL = f"""
markers(marker_no, profile, marker, category) AS (VALUES {MARKER_VALUES}),
hits AS (
  SELECT 'GCA_' || lpad(l_suppkey::varchar, 9, '0') AS genome_accession,
         coalesce(profile, 'PF99999') AS profile, l_orderkey % 40 AS protein_idx,
         l_quantity - 10 AS score, l_discount / 8000 AS evalue
  FROM lineitem LEFT JOIN markers ON l_partkey % 50 = marker_no)
"""


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as profile hits of the supplier's genome."""
    names = [p for p, _, _ in values.marker_rows()]
    profile: Column = F.get(F.array(*[F.lit(p) for p in names]), (F.col("l_partkey") % 50).cast("int"))
    needed = ("l_suppkey", "l_partkey", "l_orderkey", "l_quantity", "l_discount")
    return lines(spark, folder, *needed).select(
        F.concat(F.lit("GCA_"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias(
            "genome_accession"
        ),
        F.coalesce(profile, F.lit("PF99999")).alias("profile"),
        (F.col("l_orderkey") % 40).alias("protein_idx"),
        (F.col("l_quantity") - 10).alias("score"),
        (F.col("l_discount") / 8000).alias("evalue"),
    )


def genomes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("GCA_"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias(
            "genome_accession"
        )
    )


GENOMES_SQL = """
genomes AS (
  SELECT 'GCA_' || lpad(s_suppkey::varchar, 9, '0') AS genome_accession FROM supplier)
"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"
