"""Session settings and the two helpers that touch cluster configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. All are runtime SQL settings, so they
# can be applied to a session somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins of a hot key against a one-row-per-key table: the hot side is split
    # at run time even when that costs another exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession, scratch: str | None = None) -> SparkSession:
    """Apply :data:`RUNTIME_SETTINGS` to ``spark``.

    ``scratch`` is the checkpoint folder of a local session that names none; a
    session that sets ``spark.checkpoint.dir`` keeps its own.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir().isDefined() or context.getConf().get("spark.checkpoint.dir")
    if scratch is not None and not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(scratch)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible.

    The folder comes from ``spark.checkpoint.dir`` or from :func:`configure`. There is
    no silent default: executors cannot see each other's disks.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        context.setCheckpointDir(configured)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    Used where two branches of a plan must see exactly the same rows in the same
    partitions, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_scratch(spark: SparkSession) -> str:
    """A new folder name inside the checkpoint folder, visible to every executor."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/scratch-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables in the checkpoint folder that are deleted after their last use."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        """Write ``df``, read it back, and delete the table it replaces.

        This cuts the lineage: a lost executor costs a task that reads files.
        """
        folder = shared_scratch(self.spark)
        df.write.option("compression", "zstd").parquet(folder)
        table = self.spark.read.schema(df.schema).parquet(folder)
        if instead_of is not None:
            self.delete(instead_of)
        self.tables.append((table, folder))
        return table

    def delete(self, table: DataFrame) -> None:
        """Delete a table written here; nothing may read it any more."""
        for kept, folder in self.tables:
            if kept is table:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = [t for t in self.tables if t[0] is not table]

    def clear(self) -> None:
        """Delete all tables written here that are still there."""
        for table, _ in list(self.tables):
            self.delete(table)
