"""Table scans and sinks chosen by file suffix, chunked and incremental sinks."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cultiva.operators.ordered import row_index
from cultiva.session import materialize

FORMATS = {".parquet": "parquet", ".csv": "csv", ".jsonl": "json", ".json": "json"}
# Folders of a sink's key index.
KEY_BUCKETS = 256


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in FORMATS:
        if name.endswith(suffix):
            return suffix
    raise ValueError(f"unsupported table format: {path}")


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """Read parquet, CSV, JSON lines or JSON, told apart by suffix."""
    suffix = _suffix(path)
    reader = spark.read.format(FORMATS[suffix])
    if schema is not None:
        reader = reader.schema(schema)
    if suffix == ".csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if suffix == ".json":
        reader = reader.option("multiLine", True)
    return reader.load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write in the format named by the suffix of ``path``."""
    writer = df.write.format(FORMATS[_suffix(path)]).mode(mode)
    if _suffix(path) == ".csv":
        writer = writer.option("header", True)
    writer.save(path)


def shard(df: DataFrame, id_column: str, shards: int, index: int) -> DataFrame:
    """Keep the rows of one shard: id modulo ``shards`` equals ``index``."""
    return df.filter(F.pmod(F.col(id_column), F.lit(shards)) == index)


def _existing(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(*columns)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _bucket(key: Sequence[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in key]), F.lit(buckets)).cast("int")


def key_index(spark: SparkSession, path: str, key: Sequence[str], buckets: int = KEY_BUCKETS) -> DataFrame | None:
    """Keys of all rows of ``path`` with their hash ``bucket``, one folder per bucket; None without rows.

    The index lies below ``path`` and names the files it covers, so it never decides by
    itself: files it does not cover, of the last append or of a run that died, are
    entered first, and it is made anew when a file it covers is gone. An entry made
    twice does no harm.
    """
    rows = _existing(spark, path, key)
    if rows is None:
        return None
    index = f"{path}/_keys_{buckets}"
    there = {unquote(f.rsplit("/", 1)[-1]) for f in rows.inputFiles()}
    entered = _existing(spark, f"{index}/files", ["file"])
    covered = set() if entered is None else {r["file"] for r in entered.distinct().collect()}
    fresh, mode = there - covered, "append"
    if not covered or covered - there:
        fresh, mode = there, "overwrite"
    if fresh:
        missing = rows if mode == "overwrite" else spark.read.parquet(path).filter(
            F.col("_metadata.file_name").isin(sorted(fresh))
        ).select(*key)
        keyed = missing.withColumn("bucket", _bucket(key, buckets))
        keyed.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(f"{index}/keys")
        names = spark.createDataFrame([(f,) for f in sorted(fresh)], "file string")
        names.coalesce(1).write.mode(mode).parquet(f"{index}/files")
    # Without a row there is no bucket folder.
    schema = StructType([rows.schema[c] for c in key]).add("bucket", IntegerType())
    return spark.read.schema(schema).parquet(f"{index}/keys")


def append_new(
    df: DataFrame, key: Sequence[str], path: str, order_by: Sequence[str] = (), buckets: int = KEY_BUCKETS
) -> None:
    """Append the rows whose key is not in ``path`` yet; safe to run again.

    Of several rows of a key in ``df`` the first by ``order_by`` is taken, then by
    all other columns, so a rerun takes the same one. Known keys come from
    :func:`key_index`, of the buckets that ``df`` has keys in.
    """
    others = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*others), F.struct(*order_by, *others)) if others else None
    if first is None:
        fresh = df.distinct()
    else:
        fresh = df.groupBy(*key).agg(first.alias("_row")).select(
            *[F.col(c) if c in key else F.col("_row").getField(c).alias(c) for c in df.columns]
        )
    known = key_index(df.sparkSession, path, key, buckets)
    if known is not None:
        # Written once: its buckets are asked for before it is joined.
        fresh = materialize(fresh)
        asked = [r["bucket"] for r in fresh.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
        stored = known_keys(known, asked).select(*[F.col(c).alias(f"_known_{i}") for i, c in enumerate(key)])
        same = [F.col(c).eqNullSafe(F.col(f"_known_{i}")) for i, c in enumerate(key)]
        fresh = fresh.join(stored, same, "left_anti")
    fresh.write.mode("append").parquet(path)


def known_keys(index: DataFrame, asked: Sequence[int]) -> DataFrame:
    """Entries of some buckets: only their folders are read."""
    return index.filter(F.col("bucket").isin(sorted(asked)))


def chunk_name(stem: str, start: F.Column, stop: F.Column) -> F.Column:
    """``stem_000250_000500``: zero-padded to six digits, longer numbers in full."""
    return F.format_string(f"{stem.replace('%', '%%')}_%06d_%06d", start, stop)


def with_chunks(
    df: DataFrame, size: int, order_by: Sequence[str], stem: str, offset: int = 0
) -> DataFrame:
    """Add ``chunk``: the name of the fixed-size slice a row falls into."""
    indexed = row_index(df, order_by, into="_row", total="_rows")
    begin = F.floor(F.col("_row") / size) * size
    start = (begin + offset).cast("bigint")
    stop = (F.least(begin + size, F.col("_rows")) + offset).cast("bigint")
    return indexed.withColumn("chunk", chunk_name(stem, start, stop)).drop("_row", "_rows")


def chunk_marks(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """``(chunk, n, mark)``: rows of every chunk, and a sum of hashes of their values in any order."""
    values = sorted(c for c in df.columns if c != chunk)
    mark = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in values]) % (1 << 24))
    return df.groupBy(F.col(chunk).cast("string").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))


def write_chunks(
    df: DataFrame,
    size: int,
    path: str,
    order_by: Sequence[str],
    stem: str,
    offset: int = 0,
    resume: bool = True,
) -> DataFrame:
    """Write fixed-size chunks as partitions of ``path`` and return the whole table.

    A manifest below ``path`` gets the number of rows and a checksum of every chunk once
    its rows are written. With ``resume`` a chunk whose rows still agree with the
    manifest is left alone; one that is short, or was never entered because the run
    died, replaces what is there.
    """
    spark = df.sparkSession
    chunks = with_chunks(df, size, order_by, stem, offset)
    manifest = f"{path}/_manifest"
    entered = _existing(spark, manifest, ["chunk", "n", "mark"]) if resume else None
    if entered is not None:
        there = _existing(spark, path, chunks.columns)
        if there is not None:
            whole = chunk_marks(there).join(entered, ["chunk", "n", "mark"], "left_semi")
            chunks = chunks.join(whole.select("chunk"), "chunk", "left_anti")
    marks = materialize(chunk_marks(chunks))
    # Only the partitions that are written now are replaced.
    kept = "dynamic" if resume else "static"
    chunks.write.mode("overwrite").option("partitionOverwriteMode", kept).partitionBy("chunk").parquet(path)
    marks.write.mode("append" if resume else "overwrite").parquet(manifest)
    return spark.read.parquet(path)
