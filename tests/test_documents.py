import json

import pytest
from pyspark.sql import functions as F

from cultiva.operators import documents as O
from cultiva.sources.documents import parse_documents

STRAIN = {
    "General": {"BacDive-ID": 771, "NCBI tax id": [{"NCBI tax id": 90210, "Matching level": "species"}]},
    "Name and taxonomic classification": {
        "genus": "Halopond", "species": "Halopond salis", "family": "Ponds", "LPSN": {"family": "Halopondaceae"},
    },
    "Culture and growth conditions": {
        "culture temp": [
            {"growth": "positive", "type": "growth", "temperature": "18"},
            {"growth": "positive", "type": "growth", "temperature": "41"},
            {"growth": "negative", "type": "growth", "temperature": "60"},
            {"growth": "positive", "type": "growth", "temperature": "19"},
        ],
        "culture medium": {"name": "M", "growth": " Yes", "link": "https://x.example/medium/514a?y"},
    },
    "Physiology and metabolism": {"oxygen tolerance": [{"oxygen tolerance": "microaerophile"}]},
    "Sequence information": {"Genome sequences": [{"INSDC accession": "GCA_900777001", "assembly level": "x"}]},
}


@pytest.fixture
def docs(spark):
    def make(*records):
        rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
        return parse_documents(spark.createDataFrame(rows, "bacdive_id bigint, value string"))

    return make


def temp(*entries):
    return {"Culture and growth conditions": {"culture temp": list(entries)}}


def entry(kind, growth, value):
    return {"type": kind, "growth": growth, "temperature": value}


def test_phenotypes_of_full_document(docs):
    row = O.extract_phenotypes(docs(STRAIN)).first()
    assert row["bacdive_id"] == 771 and row["family"] == "Halopondaceae"
    assert row["ncbi_taxon_id"] == 90210 and row["genome_accession"] == "GCA_900777001"
    assert row["oxygen_requirement"] == "microaerophile" and row["optimal_temperature_c"] == 19.0
    assert len(row) == 13


@pytest.mark.parametrize(
    "document, expected",
    [
        (temp(entry("growth", "positive", "12"), entry("growth", "positive", "14"), entry("optimum", "positive", "55")), 55.0),
        (temp(entry("growth", "negative", "70"), entry("growth", "positive", "8"), entry("growth", "positive", "11")), 9.5),
        ({}, None),
        (temp(entry("Optimum", None, 30), entry("optimum", "no", "40")), 35.0),
        (temp("text", 5, None), None),
        ({"Culture and growth conditions": None}, None),
        ({"Culture and growth conditions": {"culture temp": entry("growth", "+", "12")}}, 12.0),
    ],
)
def test_optimum(docs, document, expected):
    assert O.extract_phenotypes(docs(document)).first()["optimal_temperature_c"] == expected


def test_salt(docs):
    def salt(*entries):
        record = {"Physiology and metabolism": {"halophily": list(entries)}}
        return O.extract_phenotypes(docs(record)).first()["salt_tolerance_pct"]

    def row(growth, relation, amount, **more):
        return {"growth": growth, "tested relation": relation, "concentration": amount, **more}

    assert salt(row("positive", "optimum", "3 %"), row("positive", "growth", "9 %")) == 3.0
    assert salt(row("no", "optimum", "3 %"), row("positive", "growth", "9 %")) == 9.0
    assert salt(row("positive", "growth", "2-3 %")) is None
    assert salt(row("positive", "growth", "5", salt="KCl"), row("positive", "other", "7", salt="")) == 7.0


def test_invalid_documents_are_dropped(docs):
    kept = docs({"a": 1}, "{bad", '{"a":1}{', '{"a":1} {"b":2}', "", '  {"a": 2}\n', '{"a":1}}').select("bacdive_id")
    assert sorted(r[0] for r in kept.collect()) == [0, 5]


def test_media_links(docs):
    no_link = {"Culture and growth conditions": {"culture medium": [{"name": "x"}, {"link": "/media/1"}]}}
    rows = O.strain_media_links(docs(STRAIN, no_link, {})).collect()
    assert [tuple(r) for r in rows] == [(0, "514a", "M", "yes")]


def test_recipe_keeps_rows_without_amount(docs):
    medium = {
        "medium": {"id": 1, "name": "N", "min_pH": 7, "max_pH": 7.4},
        "solutions": [{"name": "Main", "recipe": [{"compound": "NaCl", "g_l": 5, "optional": 1}, {"compound": "Agar"}, {"amount": 3}]}],
    }
    rows = O.normalize_recipes(docs(medium)).orderBy("compound").collect()
    assert [(r["compound"], r["g_l"], r["optional"]) for r in rows] == [("Agar", None, 0), ("NaCl", 5.0, 1)]
    meta = O.medium_metadata(docs(medium)).first()
    assert (meta["medium_id"], meta["max_pH"], meta["n_solutions"]) == ("1", 7.4, 1)


def test_isolation_types_and_fallbacks(docs):
    section = {"isolation": [{"country": 5, "host species": None, "sample type": "rat gut", "latitude": "n/a",
                              "sampling date": 2001, "isolation date": "May 1999"}]}
    row = O.parse_isolation(docs({O.ISOLATION: section})).first()
    assert row["iso_country"] is None and row["iso_lat"] is None
    assert row["iso_collection_year"] == 1999 and row["iso_host_kingdom"] == "animal"


def test_categories(docs):
    section = {"isolation source categories": [{"Cat1": "#Host"}, {"Cat1": "##Env "}, {"Cat1": "#Host", "Cat2": 3}]}
    row = O.extract_phenotypes(docs({O.ISOLATION: section})).first()
    assert row["isolation_cat1"] == "Env|Host" and row["isolation_cat2"] is None


def test_tax_id_skips_bad_values(docs):
    record = {"General": {"NCBI tax id": [{"NCBI tax id": "x"}, 4, {"NCBI tax id": "77"}]}}
    assert O.extract_phenotypes(docs(record)).select(F.col("ncbi_taxon_id")).first()[0] == 77
