"""From raw documents to packed training sequences, in five stages.

Documents are taken as isolation texts of strains: ``doc_id`` is the strain,
``text`` its isolation text. Every stage works on all rows that the one before it
kept. Columns other than ``doc_id`` and ``text`` travel in one struct, so none of
their names can be in the way of an operator's.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva.llm.fuzzy_lines import remove_fuzzy_lines
from cultiva.llm.jaccard import jaccard_components
from cultiva.llm.packing import pack, token_pieces
from cultiva.llm.private_data import mask_private_data
from cultiva.llm.repetition import repetition_profile
from cultiva.llm.tables import written

TOKENIZER = "word_bpe_49k.json"
WORD = r"[^\x20\x09-\x0D]"
# Near copies share this percentage of their shingles of so many words.
SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80


def _samples(docs: DataFrame) -> DataFrame:
    """Documents as isolation texts, everything else in ``_document``."""
    return docs.select(
        F.col("doc_id").alias("bacdive_id"),
        F.col("text").alias("iso_sample_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_document"),
    )


def _documents(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Back to the columns of documents; the number of characters follows the text."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[changed.get(c, F.col("_document").getField(c)).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rules or the suffix-array rule reject go."""
    profile = repetition_profile(_samples(docs), carry=["iso_sample_text", "_document"])
    kept = profile.filter("kept")
    return kept.select(
        *[
            (F.col("iso_sample_text") if c == "text" else F.col("_document").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One occurrence of each group of similar lines stays; emptied documents go."""
    kept = remove_fuzzy_lines(_samples(docs), digits=True)
    left = kept.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    return _documents(left, "kept_text", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest ``doc_id`` stays.

    Rows equal in ``doc_id`` and text are one document. Documents without words are
    similar to nothing and stay.
    """
    rows = _samples(docs).withColumn("_row", F.xxhash64(F.col("bacdive_id").cast("string"), "iso_sample_text"))
    found = written(jaccard_components(rows, ngram=SHINGLE_WORDS, percent=SHINGLE_PERCENT, carry=["_row"]))
    order = F.struct(F.col("bacdive_id").isNull(), F.col("bacdive_id"), F.col("_row"))
    first = found.filter("cluster is not null").groupBy("cluster").agg(F.min(order)["_row"].alias("_row"))
    alone = found.filter("cluster is null").select("_row")
    stays = first.select("_row").unionByName(alone).distinct()
    one = (
        rows.join(stays, "_row", "left_semi")
        .groupBy("_row")
        .agg(F.min(F.struct("_document", "iso_sample_text")).alias("_one"))
    )
    return one.select(
        *[
            (F.col("_one.iso_sample_text") if c == "text" else F.col("_one._document").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


def private_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    masked = mask_private_data(_samples(docs), into="masked_text")
    return _documents(masked, "masked_text", docs.columns)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    pieces = token_pieces(_samples(docs), public_tokenizers.path(TOKENIZER))
    return pack(
        pieces.select(
            F.col("bacdive_id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
        )
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("packing", packing),
]

# Similarity by edits, connected groups and token ids are beyond SQL; the stages are
# tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
