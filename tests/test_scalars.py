import pytest
from pyspark.sql import functions as F

from cultiva.functions import scalars as S


@pytest.mark.parametrize(
    "text, value",
    [
        ("28", 28.0), (" 28 C", 28.0), ("5-30", 17.5), ("5 - 30", 17.5), ("3 %", 3.0), ("2-3 %", None),
        ("1-2-3", 1.5), (">40", None), ("-5", -5.0), ("", None), ("  ", None), (None, None), ("1d", None),
        ("1e2", 100.0), (".5", 0.5), ("5.", 5.0), ("1e-5", None), ("abc", None), ("nan", None),
    ],
)
def test_to_float(one, text, value):
    assert one(S.to_float(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize(
    "text, year",
    [("2011-05-03", 2011), ("in 1987 or 2001", 1987), ("12345", None), ("x2011", None), ("1850", None), (None, None)],
)
def test_year(one, text, year):
    assert one(S.parse_year(F.lit(text).cast("string"))) == year


@pytest.mark.parametrize(
    "host, kingdom",
    [
        ("Homo sapiens", "human"), ("Brat plant", "animal"), ("leaf", "plant"), ("Yeast", "fungal"),
        ("granite", "other"), ("", None), (None, None), ("human plant", "human"),
    ],
)
def test_host_kingdom(one, host, kingdom):
    assert one(S.host_kingdom(F.lit(host).cast("string"))) == kingdom


@pytest.mark.parametrize(
    "lineage, name",
    [
        ("d__B;p__Bacillota;c__X", "Bacillota"), ("d__B; p__Foo ", "Foo"), ("d__B;p__;c__X", "—"),
        ("d__B", "—"), (None, "—"), ("sp__X;p__Y", "Y"),
    ],
)
def test_phylum(one, lineage, name):
    assert one(S.phylum(F.lit(lineage).cast("string"))) == name


@pytest.mark.parametrize(
    "accession, versioned",
    [("GCF_000005845.2", True), ("GCA_000511385", False), ("GCA_000511385.X", False), ("plain_text", False)],
)
def test_versions(one, accession, versioned):
    assert one(S.has_version(F.lit(accession))) is versioned
    tries = one(S.candidate_accessions(F.lit(accession)))
    assert tries == ([accession] if versioned else [f"{accession}.{i}" for i in (1, 2, 3, 4)])


def test_accession_forms(one):
    assert one(S.normalize_accession(F.lit("GB_GCA_1.1"))) == "GCA_1.1"
    assert one(S.strip_version(F.lit("GCA_1.12"))) == "GCA_1"
    assert one(S.looks_like_accession(F.lit(" gcf_000005845.2 ")))
    assert not one(S.looks_like_accession(F.lit("GCF_12")))
    assert one(S.bare_accession(F.lit("GCA_7.1"), F.lit("RS_GCF_9.1"))) == "GCA_7"
    assert one(S.bare_accession(F.lit(None).cast("string"), F.lit("RS_GCF_9.1"))) == "GCF_9"


@pytest.mark.parametrize(
    "column, family",
    [
        ("hmm_COX1_aerobic_n", "hmm:oxygen"), ("hmm_ATP_synth_alphabeta_C_present", "hmm:ph"), ("hmm_nope_score", "hmm:unknown"),
        ("hmm_odd", "baseline"), ("aa_frac_A", "composition"), ("codon_ATG", "codon"), ("tetra_AAAA", "tetra"),
        ("iso_cat1_host", "iso"), ("md_n_media", "mediadive"), ("gc_content", "baseline"),
    ],
)
def test_feature_family(one, column, family):
    assert one(S.feature_family(F.lit(column))) == family


def test_slug_and_labels(one):
    assert one(S.slugify(F.lit(" #Temp >45°C (<60)"))) == "temp_gt45_c_lt60"
    assert one(S.map_labels(F.lit("obligate aerobe"))) == "aerobe"
    assert one(S.map_labels(F.lit("new class"))) == "new class"


def test_safe_values(one):
    assert one(S.safe_float(F.lit(float("nan")), 1)) == 0.0
    assert one(S.safe_float(F.lit(None).cast("double"), 1, None)) is None
    assert one(S.safe_float(F.lit(2.25), 1)) == 2.2
    assert one(S.safe_text(F.lit(None), "—")) == "—"
    assert one(S.temperature_band(F.lit(60.0))) == ">=60"
    assert one(S.ph_band(F.lit(7.5))) == ">=7.5"


@pytest.mark.parametrize(
    "number, shown",
    [(1.6500000000000001, 1.6), (-7.8500000000000005, -7.8), (-3.9499999999999997, -4.0), (0.25, 0.2), (0.35, 0.4), (-0.04, 0.0), (1e301, 1e301)],
)
def test_displayed_ties_are_those_of_the_scaled_double(one, number, shown):
    import duckdb

    got = one(S.safe_float(F.lit(number), 1))
    assert got == shown and str(got) != "-0.0"
    assert [(shown,)] == duckdb.execute("SELECT round_even(?::double, 1) + 0.0", [number]).fetchall()
