"""The stages on the smallest folder, each against a plain version on its own input."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cultiva.llm.private_data import masked

FOLDER = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], FOLDER).write.parquet(f"{root}/{name}")
        tables.append(spark.read.parquet(f"{root}/{name}"))
    return tables


def test_columns(stages):
    assert all(t.columns == COLUMNS for t in stages[:-1])
    assert "sequence_id" in stages[-1].columns


def test_quality_rules_drop_and_change_nothing_else(stages):
    before, after = stages[0].collect(), stages[1].collect()
    assert 0 < len(after) < len(before) and set(after) <= set(before)
    assert all(len(WORD.findall(r["text"])) >= 50 for r in after)


def test_lines_occur_once(stages):
    seen, ids = {}, set()
    for row in stages[2].collect():
        assert row["n_chars"] == len(row["text"])
        for line in row["text"].split("\n"):
            words = line.split()
            if len(words) >= 3:
                seen.setdefault(line, set()).add(row["doc_id"])
        ids.add(row["doc_id"])
    # Rows equal in id and text are one document.
    assert all(len(where) == 1 for where in seen.values())


def test_one_of_each_group_stays(stages):
    sets = {}
    for row in stages[3].collect():
        words = [w.lower() for w in WORD.findall(row["text"])]
        assert row["doc_id"] not in sets
        sets[row["doc_id"]] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            assert 100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b])


def test_private_data_is_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert after == {k: masked(t) for k, t in before.items()}


def test_every_document_is_packed(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[4].collect()}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        ends = [0, *[a + b for a, b in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096


def test_empty_table(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_clashing_columns(spark, stages):
    docs = stages[0].limit(20).withColumn("kept", F.lit("x")).withColumn("n_lines", F.lit(1))
    out = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    out = corpus_pipeline.near_duplicates(spark, corpus_pipeline.line_dedup(spark, out, FOLDER), FOLDER)
    assert out.columns == docs.columns and {r["kept"] for r in out.collect()} == {"x"}


def test_near_copies_at_five_words_and_eighty_percent(spark):
    # One passage replaced: similarities of 0.70 to 0.90, among them 0.80 to 0.85.
    base = [f"w{i}" for i in range(100)]
    texts = {0: base}
    for i, cut in enumerate([2, 4, 5, 6, 7, 8, 9, 10, 12, 14]):
        own = [f"x{i}y{j}" for j in range(200)]
        texts[100 + i] = [f"{w}v{i}" for w in base]
        texts[i + 1] = [*texts[100 + i][:40], *own[:cut], *texts[100 + i][40 + cut :]]
    sets = {k: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for k, t in texts.items()}
    near = {k: len(s & sets[99 + k]) / len(s | sets[99 + k]) for k, s in sets.items() if 0 < k < 100}
    assert any(0.80 <= v < 0.85 for v in near.values()) and any(v < 0.80 for v in near.values())
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    gone = {99 + k for k, v in near.items() if v >= 0.80}
    assert kept == set(texts) - gone
