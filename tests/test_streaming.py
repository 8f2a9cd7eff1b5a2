from pyspark.sql import functions as F

from cultiva.operators.sequences import contig_stats
from cultiva.sources.sequences import scan_fasta, write_fasta
from cultiva.streaming import incremental as T


def run(spark, source, place):
    stream = T.stream_fasta(spark, source, files_per_batch=1)
    query = T.incremental_sink(stream, ["genome_accession", "contig_id"], f"{place}/out", f"{place}/state")
    query.awaitTermination()
    return sorted((r[0], r[1]) for r in spark.read.parquet(f"{place}/out").select("genome_accession", "contig_id").collect())


def test_new_files_are_added_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "G1.fna").write_text(">a\nACGT\n>b\nGG\n")
    assert run(spark, str(source), tmp_path) == [("G1", "a"), ("G1", "b")]
    (source / "G2.fna").write_text(">a\nAC\n>a\nAC\n")
    assert run(spark, str(source), tmp_path) == [("G1", "a"), ("G1", "b"), ("G2", "a")]
    assert len(run(spark, str(source), tmp_path)) == 3


def test_partition_folders_as_genomes(spark, tmp_path):
    contigs = spark.createDataFrame([("G 1", "a", "ACGT"), ("G2", "a", "GG")], "genome_accession string, contig_id string, seq string")
    write_fasta(contigs, f"{tmp_path}/in", compression="none")
    assert run(spark, f"{tmp_path}/in/*", tmp_path) == [("G 1", "a"), ("G2", "a")]
    assert len(run(spark, f"{tmp_path}/in/*", tmp_path)) == 2


def test_resume_skips_finished_genomes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "G1.fna").write_text(">a\nGGCC\n")
    seen = []

    def featurize(contigs):
        seen.append(sorted({r[0] for r in contigs.select("genome_accession").collect()}))
        return contig_stats(contigs)

    out = f"{tmp_path}/features"
    T.resume_featurize(scan_fasta(spark, str(source)), featurize, ["genome_accession"], out)
    (source / "G2.fna").write_text(">a\nAA\n")
    T.resume_featurize(scan_fasta(spark, str(source)), featurize, ["genome_accession"], out)
    assert seen == [["G1"], ["G2"]]
    assert spark.read.parquet(out).count() == 2


def test_progress(spark):
    from pyspark.sql import Observation

    results = spark.createDataFrame([(1, True), (2, False), (2, None)], "id int, ok boolean")
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert tuple(T.progress(tasks, results, ["id"], "ok").first()) == (2, 1, 1)
    watch = Observation("featurize")
    T.with_progress(results, watch, "ok").write.format("noop").mode("overwrite").save()
    assert watch.get == {"completed": 3, "success": 1}
    assert results.filter(F.col("ok")).count() == 1


def test_tables_of_one_file_and_of_a_folder(spark, tmp_path):
    rows = spark.range(20).repartition(3)
    rows.write.parquet(f"{tmp_path}/in/folder.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "in" / "file.parquet")
    for pattern in ("folder.parquet", "file.parquet", "*.parquet"):
        stream = T.stream_table(spark, f"{tmp_path}/in", "id bigint", pattern)
        place = f"{tmp_path}/{pattern.replace('*', 'all')}"
        T.incremental_sink(stream, ["id"], f"{place}-out", f"{place}-state").awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(f"{place}-out").collect()) == list(range(20))
