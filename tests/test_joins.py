import pytest
from pyspark.sql import functions as F

from cultiva.operators import aggregates as A
from cultiva.operators import encode as N
from cultiva.operators import filters as P
from cultiva.operators import joins as J
from cultiva.operators import vectors as V


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame([(1, "G1", 0.1), (2, "G2", 0.2)], "bacdive_id bigint, genome_accession string, feature double")


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame(
        [("G1", {"oxygen": ["MK"]}, {"oxygen": 1}, 1), ("G1", {"oxygen": ["XX"]}, {"oxygen": 9}, 2)],
        "genome_accession string, by_category map<string,array<string>>, category_counts map<string,int>, line int",
    )


def test_sequence_join_modes(features, sequences):
    inner = J.join_sequences(features, sequences, ["line"]).collect()
    assert [(r["genome_accession"], r["category_counts"]) for r in inner] == [("G1", {"oxygen": 1})]
    left = {r["genome_accession"]: r["by_category"] for r in J.join_sequences(features, sequences, ["line"], matched_only=False).collect()}
    assert set(left) == {"G1", "G2"} and left["G2"] is None


def test_sequence_join_checks_columns(features, sequences):
    with pytest.raises(ValueError, match="by_category"):
        J.join_sequences(features, sequences.drop("by_category"), ["line"])
    with pytest.raises(ValueError, match="genome_accession"):
        J.join_sequences(features.drop("genome_accession"), sequences, ["line"])


def test_hybrid_fallback_and_order(spark, features):
    rows = features.withColumns({"pred_oxygen_requirement": F.lit("anaerobe"), "pred_oxygen_requirement_confidence": F.lit(0.7)})
    tabular = features.select("genome_accession", F.lit(7.0).alias("pred_optimal_ph"), F.lit(30.0).alias("pred_optimal_temperature_c"))
    oxygen = spark.createDataFrame(
        [("G2", 0.9, 0.1, "aerobe", 0.9, "model")],
        "genome_accession string, pred_oxygen_requirement_prob_aerobe double, pred_oxygen_requirement_prob_anaerobe double, "
        "pred_oxygen_requirement string, pred_oxygen_requirement_confidence double, pred_oxygen_requirement_source string",
    )
    got = J.hybrid_predictions(rows, tabular, oxygen)
    assert got.columns == [
        "bacdive_id", "genome_accession", "pred_optimal_temperature_c", "pred_optimal_ph", "pred_oxygen_requirement",
        "pred_oxygen_requirement_confidence", "pred_oxygen_requirement_source",
        "pred_oxygen_requirement_prob_aerobe", "pred_oxygen_requirement_prob_anaerobe",
    ]
    found = {r["genome_accession"]: (r[4], r[5], r[6]) for r in got.collect()}
    assert found == {"G1": ("anaerobe", 0.7, "tabular"), "G2": ("aerobe", 0.9, "model")}
    without_model = J.hybrid_predictions(rows, tabular, oxygen.select("genome_accession"))
    assert {r["pred_oxygen_requirement_source"] for r in without_model.collect()} == {"tabular"}


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None)], "genome_accession string, pred_t double, other string")
    newer = spark.createDataFrame([("a", None, 5), ("b", 9.0, 6)], "genome_accession string, pred_t double, pred_new int")
    got = {r["genome_accession"]: (r["pred_t"], r["pred_new"], r["pred_oxygen_requirement_source"]) for r in J.overlay(base, newer).collect()}
    assert got == {"a": (1.0, 5, "tabular"), "b": (9.0, 6, "tabular")}


def test_backfill_uses_one_hit_per_species(spark):
    strains = spark.createDataFrame([(1, "A b", None), (2, "A b", "G"), (3, "C d", None)], "bacdive_id int, species string, genome_accession string")
    resolved = spark.createDataFrame([("A b", "N1", "hit"), ("A b", "N1", "hit"), ("C d", None, "miss")], "species string, ncbi_accession string, status string")
    got = {r["bacdive_id"]: (r["genome_accession"], r["genome_source"]) for r in J.backfill_accession(strains, resolved).collect()}
    assert got == {1: ("N1", "species_resolved"), 2: ("G", "bacdive"), 3: (None, "bacdive")}


def test_label_sources(spark):
    df = spark.createDataFrame(
        [(1, None, "", None), (2, 7.0, "aerobe", 1.0), (3, float("nan"), None, None)],
        "bacdive_id bigint, optimal_ph double, oxygen_requirement string, salt_tolerance_pct double",
    )
    media = spark.createDataFrame([(1, 6.5, None), (3, None, 2.0)], "bacdive_id bigint, md_ph_median double, md_nacl_pct_median double")
    rows = {r["bacdive_id"]: r for r in J.merge_label_sources(df, media).collect()}
    assert (rows[1]["optimal_ph"], rows[1]["optimal_ph_source"]) == (6.5, "mediadive_weak")
    assert rows[1]["oxygen_requirement"] is None and rows[1]["oxygen_requirement_source"] == "unknown"
    assert rows[2]["optimal_ph_source"] == "bacdive"
    assert (rows[3]["optimal_ph"], rows[3]["optimal_ph_source"], rows[3]["salt_tolerance_pct"]) == (None, "unknown", 2.0)


def test_file_coverage(spark):
    manifest = spark.createDataFrame([("GCA_1",), ("GCA_1",), ("GCA_2",)], "genome_accession string")
    files = spark.createDataFrame([("GCA_1.fna.gz",), ("GCA_9.fa",)], "file_name string")
    assert tuple(A.file_coverage(manifest, files).first()) == (2, 1, 1, 50.0)


def test_marker_summary_defaults_and_ties(spark):
    hits = spark.createDataFrame(
        [("G", "m1", 10.0, 1e-9), ("G", "m1", 10.0, 1e-12), ("G", "m1", 3.0, 1e-20), ("G", "m2", -1.0, 1e-6), ("G", "m1", 99.0, 1e-3)],
        "genome_accession string, marker string, score double, evalue double",
    )
    got = {r["marker"]: (r["n_hits"], r["top_score"], r["top_evalue"]) for r in A.marker_summary(hits).collect()}
    assert got == {"m1": (3, 10.0, 1e-12), "m2": (1, 0.0, 1.0)}
    wide = A.marker_pivot(spark.createDataFrame([("G",), ("H",)], "genome_accession string"), A.marker_summary(hits), ["m1", "m2", "m3"])
    rows = {r["genome_accession"]: r for r in wide.collect()}
    assert rows["G"]["hmm_m2_present"] == 1.0 and rows["G"]["hmm_m3_n"] == 0.0 and rows["H"]["hmm_m1_score"] == 0.0


def test_label_table(spark):
    features = spark.createDataFrame([(i,) for i in range(5)], "bacdive_id bigint")
    links = spark.createDataFrame(
        [(0, "A", "yes"), (0, "A", "yes"), (1, "A", "Yes"), (2, "B", "yes"), (3, "A", "no"), (9, "A", "yes")],
        "bacdive_id bigint, medium_id string, growth string",
    )
    strains, positives, media = N.label_table(features, links, minimum=3)
    assert sorted(r[0] for r in strains.collect()) == [0, 1, 2, 3]
    assert sorted(map(tuple, positives.collect())) == [(0, "A"), (1, "A")]
    assert [tuple(r) for r in media.collect()] == [("A", 3)]
    dense = {r[0]: r["A"] for r in N.label_matrix(strains, positives, ["A"]).collect()}
    assert dense == {0: 1, 1: 1, 2: 0, 3: 0}


def test_one_hot_slug_collisions(spark):
    df = spark.createDataFrame([("Soil|soil!",), ("soil!",), (None,)], "isolation_cat1 string")
    wide, columns = N.one_hot_tags(df, ["isolation_cat1"], min_count=1)
    assert columns == ["iso_cat1_soil"]
    assert [r["iso_cat1_soil"] for r in wide.collect()] == [1, 0, 0]


def test_presets_and_guards(spark):
    df = spark.createDataFrame(
        [(60.0, "Facultative ANAEROBE", 1.0), (10.0, None, 4.0)],
        "pred_optimal_temperature_c double, pred_oxygen_requirement string, pred_salt_tolerance_pct double",
    )
    counts = {p: P.catalog_preset(df, p).count() for p in ("all", "thermo", "psychro", "anaerobe", "halo")}
    assert counts == {"all": 2, "thermo": 1, "psychro": 1, "anaerobe": 1, "halo": 1}
    with pytest.raises(ValueError):
        P.catalog_preset(df, "other")
    assert P.drop_leaky(["md_ph", "gc"], "optimal_ph") == ["gc"]
    assert P.drop_leaky(["md_ph", "gc"], "oxygen_requirement") == ["md_ph", "gc"]
    assert P.trainable_targets(df, ["pred_oxygen_requirement", "absent"], 2) == []


def test_vectors(spark):
    df = spark.createDataFrame([("G", 0, [1.0, 2.0]), ("G", 1, [3.0, 6.0])], "genome_accession string, protein_idx int, embedding array<float>")
    genomes = spark.createDataFrame([("G",), ("H",)], "genome_accession string")
    got = {r["genome_accession"]: (r["embedding"], r["n"]) for r in V.mean_pool_all(genomes, df, 2).collect()}
    assert got == {"G": ([2.0, 4.0], 2), "H": ([0.0, 0.0], 0)}
    hits = spark.createDataFrame([("G", "salt", 0), ("G", "ph", 0), ("G", "ph", 1)], "genome_accession string, category string, protein_idx int")
    row = V.pool_per_category(genomes, hits, df, 2).filter("genome_accession = 'G'").first()
    assert row["pme_marker_proteins_total"] == 2 and row["pme_ph_n"] == 2 and row["pme_salt"] == [1.0, 2.0] and row["pme_oxygen"] == [0.0, 0.0]
    assert len(V.concat_categories(V.pool_per_category(genomes, hits, df, 2)).first()["embedding"]) == 16


def test_sampling_is_repeatable(spark):
    df = spark.range(100).withColumnRenamed("id", "protein_idx").select(F.lit("G").alias("genome_accession"), "protein_idx", F.array(F.col("protein_idx").cast("double")).alias("embedding"))
    a, b = (V.sample_then_pool(x, 10, "protein_idx").first() for x in (df, df.repartition(5)))
    assert a == b and a["n"] == 10
