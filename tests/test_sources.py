import gzip

import pytest
from pyspark.sql import functions as F

from cultiva.sources import annotations as AN
from cultiva.sources import tables as T
from cultiva.sources.documents import scan_documents, scan_json_lines
from cultiva.sources.sequences import scan_fasta, write_fasta


def test_documents_by_file_name(spark, tmp_path):
    (tmp_path / "12.json").write_text('{"a": 1}')
    (tmp_path / "x1.json").write_text('{"a": 2}')
    (tmp_path / "13.json").write_text("{broken")
    assert [r["bacdive_id"] for r in scan_documents(spark, str(tmp_path)).collect()] == [12]


def test_one_file_for_each_name_written_by_tasks(spark, tmp_path):
    from suite.files import one_file_each

    rows = spark.range(300).selectExpr("cast(id AS string) AS name", "concat('{\"a\": ', id, '}') AS value")
    for _ in range(2):  # again: the same files
        one_file_each(rows, f"file:{tmp_path}/out", "json")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"{i}.json": f'{{"a": {i}}}\n' for i in range(300)}
    assert sorted(r["bacdive_id"] for r in scan_documents(spark, f"{tmp_path}/out").collect()) == list(range(300))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\nnot json\n{"a": 3}\n')
    assert sorted(r["a"] for r in scan_json_lines(spark, str(path), "a int").collect()) == [1, 3]


@pytest.mark.parametrize("suffix", ["parquet", "csv", "jsonl", "json"])
def test_table_formats(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    path = f"{tmp_path}/t.{suffix}"
    T.write_table(df, path)
    if suffix == "json":
        (tmp_path / "whole.json").write_text('[{"id": 1, "name": "a"},\n {"id": 2, "name": "b"}]')
        path = f"{tmp_path}/whole.json"
    back = T.read_table(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        T.read_table(spark, f"{tmp_path}/t.xlsx")


def test_fasta(spark, tmp_path):
    (tmp_path / "G1.fna").write_text(">contig_1 a > b\nACGTac\r\ngtgcta\n>contig_2\nNNNN\n")
    with gzip.open(tmp_path / "G2.1.fasta.gz", "wt") as handle:
        handle.write(">c\n" + "ACGT" * 50 + "\n")
    (tmp_path / "empty.fa").write_text("")
    rows = {(r["genome_accession"], r["contig_id"]): r["seq"] for r in scan_fasta(spark, str(tmp_path)).collect()}
    assert rows == {("G1", "contig_1"): "ACGTACGTGCTA", ("G1", "contig_2"): "NNNN", ("G2.1", "c"): "ACGT" * 50}


def test_write_fasta_wraps(spark, tmp_path):
    df = spark.createDataFrame([("G", "c", "A" * 160), ("G", "d", "C" * 81)], "genome_accession string, contig_id string, seq string")
    write_fasta(df, f"{tmp_path}/out", compression="none")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("genome_accession=G/*.txt"))
    assert max(len(line) for line in text.splitlines()) == 80
    assert sorted(text.splitlines()) == sorted([">c", "A" * 80, "A" * 80, ">d", "C" * 80, "C"])


def test_modules(spark, tmp_path):
    path = tmp_path / "modules"
    path.write_text(
        "ENTRY       M00001   Pathway\nNAME        First\nDEFINITION  K00002 (K00001,\n            K00003)\nCLASS       A;\n            B\nORTHOLOGY   K9\n///\n"
        "ENTRY       M00002\nNAME        No rule\n///\n"
    )
    row, = AN.scan_modules(spark, str(path)).collect()
    assert row["id"] == "M00001" and row["definition"] == "K00002 (K00001, K00003)"
    assert row["ko_list"] == ["K00001", "K00002", "K00003"] and row["category"] == "A; B"


def test_traits(spark, tmp_path):
    (tmp_path / "GCA_1.2.tsv").write_text(
        "\tvalue\terror\ntemperature_optimum\t42.5\t1.5\nph_optimum\t7.25\t0.2\nsalinity_optimum\t1.75\t0.3\noxygen\ttolerant\t0.9\n"
    )
    row = AN.scan_trait_predictions(spark, str(tmp_path)).first()
    assert row["genome_accession"] == "GCA_1.2" and row["external_temperature_c"] == 42.5
    assert row["external_salt_error"] == 0.3 and row["external_oxygen"] == "tolerant"
    assert row["external_oxygen_probability"] == 0.9


def test_append_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        T.append_new(df, ["id"], f"{tmp_path}/log")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2]


def test_chunks(spark, tmp_path):
    df = spark.range(7).withColumn("v", F.col("id") * 2)
    whole = T.write_chunks(df, 3, f"{tmp_path}/c", ["id"], "hybrid_predictions", offset=250)
    assert sorted({r["chunk"] for r in whole.collect()}) == [
        "hybrid_predictions_000250_000253", "hybrid_predictions_000253_000256", "hybrid_predictions_000256_000257",
    ]
    again = T.write_chunks(df, 3, f"{tmp_path}/c", ["id"], "hybrid_predictions", offset=250)
    assert again.count() == 7


def test_a_short_chunk_is_written_again(spark, tmp_path):
    df = spark.range(90).select("id", (F.col("id") * 2).alias("x")).repartition(4)
    path = tmp_path / "c"
    T.write_chunks(df, 30, str(path), ["id"], "pred")
    stamps = {f: f.stat().st_mtime_ns for f in path.glob("chunk=*/*.parquet")}
    parts = sorted(path.glob("chunk=pred_000030_000060/*.parquet"))
    parts[0].unlink()
    again = T.write_chunks(df, 30, str(path), ["id"], "pred")
    assert sorted(r["id"] for r in again.collect()) == list(range(90))
    untouched = [f for f in stamps if "000030_000060" not in str(f)]
    assert untouched and all(f.exists() and f.stat().st_mtime_ns == stamps[f] for f in untouched)
    # Rows without an entry in the manifest are those of a run that died before it was done.
    for f in (path / "_manifest").glob("*"):
        f.unlink()
    assert T.write_chunks(df, 30, str(path), ["id"], "pred").count() == 90
    assert T.write_chunks(df.withColumn("x", F.col("x") + 1), 30, str(path), ["id"], "pred").count() == 90


def test_metadata_columns_and_thresholds(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("accession\tx\tcheckm_completeness\nRS_GCF_1\t9\t95\n")
    assert AN.scan_genome_metadata(spark, f"{tmp_path}/m.tsv").columns == ["accession", "checkm_completeness"]
    (tmp_path / "ko.tsv").write_text("ko\tthreshold\nK1\t12.5\nK2\t-\n")
    assert {tuple(r) for r in AN.scan_ko_thresholds(spark, f"{tmp_path}/ko.tsv").collect()} == {("K1", 12.5), ("K2", 0.0)}


def keys_of(spark, path):
    return sorted(r["genome_accession"] for r in spark.read.parquet(path).select("genome_accession").collect())


def test_key_index_covers_every_file_of_a_sink(spark, tmp_path):
    path = f"{tmp_path}/contig stats"

    def rows(names):
        return spark.createDataFrame([(n, 1.0) for n in names], "genome_accession string, gc_content double")

    T.append_new(rows(["G1", "G2", None]), ["genome_accession"], path)
    T.append_new(rows(["G2", "G3"]), ["genome_accession"], path)
    # Rows of a run that died before anything was entered.
    rows(["G4"]).write.mode("append").parquet(path)
    T.append_new(rows(["G1", "G3", "G4", "G5"]), ["genome_accession"], path)
    T.append_new(rows(["G5", None]), ["genome_accession"], path)
    stored = [r[0] for r in spark.read.parquet(path).select("genome_accession").collect()]
    assert sorted(k for k in stored if k) == [f"G{i}" for i in range(1, 6)] and stored.count(None) == 1
    index = T.key_index(spark, path, ["genome_accession"])
    assert sorted({r["genome_accession"] for r in index.filter("genome_accession is not null").collect()}) == [f"G{i}" for i in range(1, 6)]


def test_key_index_reads_the_buckets_asked_for(spark, tmp_path):
    path = f"{tmp_path}/sink"
    T.append_new(spark.range(2000).withColumnRenamed("id", "bacdive_id"), ["bacdive_id"], path)
    index = T.key_index(spark, path, ["bacdive_id"], 16)
    asked = T.known_keys(index, [3])
    assert "PartitionFilters: [isnotnull(bucket" in asked._jdf.queryExecution().toString()
    assert 0 < len(asked.inputFiles()) and asked.select("bucket").distinct().count() == 1
    assert index.count() == 2000


def test_key_index_is_made_anew_when_a_file_is_gone(spark, tmp_path):
    path = tmp_path / "sink"
    one = spark.createDataFrame([("G1",)], "genome_accession string").coalesce(1)
    T.append_new(one, ["genome_accession"], str(path))
    T.append_new(one, ["genome_accession"], str(path))
    for part in path.glob("*.parquet"):
        part.unlink()
    T.append_new(one, ["genome_accession"], str(path))
    T.append_new(one, ["genome_accession"], str(path))
    assert keys_of(spark, str(path)) == ["G1"]
