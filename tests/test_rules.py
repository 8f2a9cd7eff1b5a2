import random

import pytest

from cultiva.operators import rules as R


def scores(spark, rules, hits, fractional=True):
    modules = spark.createDataFrame([(f"M{i}", d) for i, d in enumerate(rules)], "id string, definition string")
    held = spark.createDataFrame([("G", k) for k in hits] or [("G", "none")], "genome_accession string, ko string")
    rows = R.module_completeness(held, R.rule_nodes(modules), fractional).collect()
    found = {r["module"]: r["completeness"] for r in rows}
    return [found.get(f"M{i}", 0.0) for i in range(len(rules))]


def test_hand_worked_rules(spark):
    rules = [
        "K00001 (K00002,K00003) K00004",
        "(K00001 K00002,K00003)",
        "",
        "K00001,K00002 K00003",
        "K00001 , K00003",  # comma after a blank: an empty step
        "K00001, K00003",  # blank after a comma: an empty alternative
        "K00001) K00002",  # stray bracket ends the rule
        "M00001 K00001",
        "K00001 ()",
        "K00001+K00002-K00003",
        "(K00002,(K00001 K00003))",
        "K00001,,K00003",
    ]
    fractional = [2 / 3, 1.0, 0.0, 1.0, 2 / 3, 1.0, 1.0, 1.0, 0.5, 2 / 3, 1.0, 1.0]
    strict = [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    hits = ["K00001", "K00003"]
    assert scores(spark, rules, hits) == pytest.approx(fractional)
    assert scores(spark, rules, hits, fractional=False) == pytest.approx(strict)


def test_unclosed_brackets_are_rejected(spark):
    modules = spark.createDataFrame([("bad", "K00001 (K00002"), ("eaten", "(K00001,)"), ("good", "K00001")], "id string, definition string")
    assert {r[0] for r in R.rejected_rules(modules).collect()} == {"bad", "eaten"}
    assert {r["module"] for r in R.rule_nodes(modules).collect()} == {"good"}


def make_rule(rng, depth):
    """Random rule text with a function that scores it."""
    steps = []
    for _ in range(rng.randint(1, 3)):
        members = []
        for _ in range(rng.randint(1, 3)):
            if depth and rng.random() < 0.4:
                text, score = make_rule(rng, depth - 1)
                members.append((f"({text})", score))
            else:
                ko = f"K{rng.randint(1, 12):05d}"
                members.append((ko, lambda held, strict, ko=ko: float(ko in held)))
        steps.append(members)

    def total(held, strict):
        found = [max(score(held, strict) for _, score in members) for members in steps]
        return min(found) if strict else sum(found) / len(found)

    return " ".join(",".join(text for text, _ in members) for members in steps), total


def test_random_rules_against_direct_scoring(spark):
    rng = random.Random(5)
    made = [make_rule(rng, 3) for _ in range(60)]
    held = {f"K{i:05d}" for i in (1, 3, 4, 8, 9)}
    rules = [text for text, _ in made]
    assert scores(spark, rules, held) == pytest.approx([f(held, False) for _, f in made])
    assert scores(spark, rules, held, False) == pytest.approx([f(held, True) for _, f in made])


def test_matrix_fills_zero(spark):
    modules = spark.createDataFrame([("M1", "K00001"), ("M2", "K00002")], "id string, definition string")
    held = spark.createDataFrame([("G", "K00001")], "genome_accession string, ko string")
    genomes = spark.createDataFrame([("G",), ("H",)], "genome_accession string")
    done = R.module_completeness(held, R.rule_nodes(modules))
    rows = {r[0]: tuple(r)[1:] for r in R.module_matrix(genomes, done, ["M1", "M2"]).collect()}
    assert rows == {"G": (1.0, 0.0), "H": (0.0, 0.0)}
