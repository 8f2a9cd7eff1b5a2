"""Process newly arrived genomes exactly once and resume after a crash."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cultiva.operators.joins import pending
from cultiva.sources.sequences import genome_of_file, parse_fasta_records
from cultiva.sources.tables import append_new


def stream_fasta(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Contigs of FASTA files, or of partition folders with them, as they arrive."""
    reader = spark.readStream.format("text").schema("value string").option("lineSep", "\n>")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    records = reader.load(path).select(genome_of_file().alias("genome_accession"), "value")
    return parse_fasta_records(records)


def stream_table(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.parquet"
) -> DataFrame:
    """Rows of parquet files below ``path`` as they arrive.

    ``pattern`` names files, or folders of files: a table may be either.
    """
    # A stream takes no path of one file, but a glob that matches it.
    return spark.readStream.schema(schema).parquet(f"{path}/{{{pattern}}}")


def incremental_sink(
    stream: DataFrame, key: Sequence[str], out_path: str, checkpoint: str
) -> StreamingQuery:
    """Append one row of every new key to ``out_path`` until the input is used up.

    The checkpoint records which files are done. Each batch is held against the sink's
    key index, of which it reads the buckets it has keys in, so no state grows with the
    stream and a batch that runs again after a failure adds nothing twice. ``checkpoint`` must be on storage all
    executors share.
    """

    def append(batch: DataFrame, _: int) -> None:
        append_new(batch, key, out_path)

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deduplicated(stream: DataFrame, key: Sequence[str], time: str, late_by: str) -> DataFrame:
    """First row per key within the watermark; state older than ``late_by`` is dropped."""
    return stream.withWatermark(time, late_by).dropDuplicatesWithinWatermark(list(key))


def resume_featurize(
    inputs: DataFrame,
    featurize: Callable[[DataFrame], DataFrame],
    key: Sequence[str],
    out_path: str,
) -> None:
    """Featurize the inputs whose key has no stored row yet and append the result.

    Done keys are removed before the expensive step. Running again, also after a
    failure halfway, adds nothing twice.
    """
    spark = inputs.sparkSession
    try:
        done = spark.read.parquet(out_path).select(*key).distinct()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        todo = inputs
    else:
        todo = pending(inputs, done, key)
    append_new(featurize(todo), key, out_path)


def with_progress(df: DataFrame, name: str, success: str) -> DataFrame:
    """Count completed and successful rows while a job runs.

    Read them from an ``Observation`` or from the query progress under ``name``.
    """
    return df.observe(
        name,
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.coalesce(F.col(success), F.lit(False))).alias("success"),
    )


def progress(tasks: DataFrame, results: DataFrame, key: Sequence[str], success: str) -> DataFrame:
    """Completed, successful and pending tasks of a resumable job."""
    state = (
        results.select(*key, F.coalesce(F.col(success), F.lit(False)).alias("_ok"))
        .groupBy(*key)
        .agg(F.bool_or("_ok").alias("_ok"))
    )
    return (
        tasks.select(*key)
        .distinct()
        .join(state, list(key), "left")
        .agg(
            F.count("_ok").alias("completed"),
            F.count_if(F.col("_ok")).alias("success"),
            F.count_if(F.col("_ok").isNull()).alias("pending"),
        )
    )
