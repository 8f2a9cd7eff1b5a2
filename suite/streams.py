"""Incremental processing of arriving documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.operators.sequences import contig_stats
from cultiva.session import shared_scratch
from cultiva.streaming import incremental as T
from suite.base import GENOME_SQL, contigs, query, r, rounded, table, with_sql


@query(
    "incremental_contig_stream",
    """SELECT source AS genome_accession, doc_id AS contig_id, length(text)::int AS n,
  (length(text) - length(translate(text, 'gc', '')))::int AS gc FROM documents""",
)
def incremental_contig_stream(spark, folder):
    schema = table(spark, folder, "documents").schema
    stream = T.stream_table(spark, folder, schema, "documents.parquet")
    # every contig arrives twice
    twice = stream.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).select(
        F.col("source").alias("genome_accession"),
        F.col("doc_id").alias("contig_id"),
        F.length("text").alias("n"),
        (F.length("text") - F.length(F.translate("text", "gc", ""))).alias("gc"),
    )
    place = shared_scratch(spark)
    keys = ["genome_accession", "contig_id"]
    for _ in range(2):  # the second run finds nothing new
        T.incremental_sink(twice, keys, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out")


@query("event_stream_within_watermark", "SELECT event_id, user_id, event_type FROM events")
def event_stream_within_watermark(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = T.stream_table(spark, folder, schema, "events.parquet")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = timed.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = T.deduplicated(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type")
    place = shared_scratch(spark)
    (
        once.writeStream.format("parquet")
        .option("path", f"{place}/out")
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{place}/out")


@query(
    "resume_featurize",
    with_sql(GENOME_SQL)
    + f"""SELECT genome_accession, sum(length(seq))::double AS genome_size_nt, count(*)::double AS n_contigs,
  {r("sum(length(seq) - length(translate(seq, 'GC', ''))) / sum(length(seq))")} AS gc_content FROM contigs GROUP BY 1""",
)
def resume_featurize(spark, folder):
    place = shared_scratch(spark)
    everything = contigs(spark, folder)
    # a first run stops early, the second picks up what is missing
    early = everything.filter(F.col("genome_accession") < "src2")
    for inputs in (early, everything):
        T.resume_featurize(inputs, contig_stats, ["genome_accession"], f"{place}/features")
    return rounded(spark.read.parquet(f"{place}/features"))


@query(
    "progress_counters",
    """SELECT count(o) AS completed, count(*) FILTER (WHERE o) AS success, count(*) FILTER (WHERE o IS NULL) AS pending FROM customer
LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS o FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""",
)
def progress_counters(spark, folder):
    results = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("task"), (F.col("o_orderstatus") == "F").alias("ok")
    )
    tasks = table(spark, folder, "customer").select(F.col("c_custkey").alias("task"))
    return T.progress(tasks, results, ["task"], "ok")
