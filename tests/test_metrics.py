import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cultiva.operators import metrics as M
from cultiva.operators import ranking as W
from cultiva.plans import recommender as P


def test_topk_of_two_rows(spark):
    # First strain: true media at ranks 2 and 4 of 4. Second: at rank 1 of 4.
    y, s = [[1, 0, 0, 1], [0, 0, 1, 0]], [[0.5, 0.6, 0.4, 0.3], [0.1, 0.2, 0.7, 0.0]]
    rows = [(i, f"m{j}", y[i][j], s[i][j]) for i in range(2) for j in range(4)] + [(9, "m0", 0, 1.0)]
    df = spark.createDataFrame(rows, "bacdive_id int, medium_id string, y int, score double")
    got = P.model_benchmark(df, (1,)).first()
    assert got["n_eval"] == 2 and got["mean_true_media"] == 1.5
    assert (got["hit_at_1"], got["mrr"], got["recall_at_1"], got["precision_at_1"]) == (0.5, 0.75, 0.5, 0.5)


def test_taxonomic_fallback(spark):
    strains = spark.createDataFrame(
        [(i, 0, "Ga", "Fa") for i in range(11, 15)] + [(21, 0, "Gb", "Fb"), (31, 1, "Ga", "Fa"), (32, 1, "", None)],
        "bacdive_id int, fold int, genus string, family string",
    )
    positives = spark.createDataFrame([(11, "A"), (12, "A"), (13, "B"), (14, "B"), (21, "B")], "bacdive_id int, medium_id string")
    used, scores = M.taxonomy_scores(strains, positives)
    levels = {r["bacdive_id"]: (r["level"], r["taxon"]) for r in used.collect()}
    assert levels[31] == ("genus", "Ga") and levels[32] == ("global", "")
    got = {(r["fold"], r["level"], r["medium_id"]): r["score"] for r in scores.collect()}
    assert (got[1, "genus", "A"], got[1, "genus", "B"]) == (0.5, 0.5)
    assert (got[1, "global", "A"], got[1, "global", "B"]) == (0.4, 0.6)


def test_taxonomy_scores_of_every_medium(spark):
    strains = spark.createDataFrame(
        [(i, 0, "Ga", "Fa") for i in range(11, 15)] + [(31, 1, "Ga", "Fa"), (32, 1, "", None)],
        "bacdive_id int, fold int, genus string, family string",
    )
    positives = spark.createDataFrame([(11, "A"), (32, "B")], "bacdive_id int, medium_id string")
    media = spark.createDataFrame([("A",), ("B",), ("C",)], "medium_id string")
    got = M.every_medium(*M.taxonomy_scores(strains, positives), media).collect()
    assert {(r["fold"], r["level"], r["taxon"], r["medium_id"]): r["score"] for r in got} == {
        (fold, level, taxon, m): score
        for (fold, level, taxon), scores in {
            (1, "genus", "Ga"): (0.25, 0.0, 0.0), (1, "global", ""): (0.25, 0.0, 0.0), (0, "global", ""): (0.0, 0.5, 0.0),
        }.items()
        for m, score in zip("ABC", scores)
    }


def test_sparse_ranks_are_those_of_the_whole_grid(spark):
    rng = np.random.default_rng(8)
    media = [f"m{i:02d}" for i in range(12)]
    scores = {(t, m): float(rng.integers(1, 4)) for t in "abc" for m in media if rng.random() < 0.4}
    grid = {t: sorted(media, key=lambda m: (-scores.get((t, m), 0.0), m)) for t in "abcd"}
    frame = spark.createDataFrame([(t, m, s) for (t, m), s in scores.items()], "taxon string, medium_id string, score double")
    wanted = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate((t, m) for t in "abcd" for m in media[::2] * 2)], "id int, taxon string, medium_id string")
    got = M.sparse_ranks(wanted, frame, spark.createDataFrame([(m,) for m in media], "medium_id string"), ["taxon"]).collect()
    assert len(got) == wanted.count()
    assert all(r["rank"] == grid[r["taxon"]].index(r["medium_id"]) + 1 for r in got)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    average, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        kept = s >= t
        r = y[kept].sum() / y.sum()
        average += (r - recall) * y[kept].mean()
        recall = r
    return average, wins / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    frames = []
    for medium in ("a", "b"):
        y = (rng.random(500) < 0.2).astype(int)
        frames.append(pd.DataFrame({"medium_id": medium, "y": y, "score": np.round(rng.random(500) + y * 0.3, 1)}))
    frames.append(pd.DataFrame({"medium_id": "one class", "y": 0, "score": [0.1, 0.2]}))
    df = spark.createDataFrame(pd.concat(frames))
    got = {r["medium_id"]: r for r in M.per_medium_auc(df).collect()}
    assert set(got) == {"a", "b"}
    for frame in frames[:2]:
        ap, roc = brute_auc(frame["y"].to_numpy(), frame["score"].to_numpy())
        row = got[frame["medium_id"].iloc[0]]
        assert row["pr_auc"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(roc)


CLASSES = ["aerobe", "anaerobe", "facultative_anaerobe", "microaerobe"]


def diagnostics(spark, pairs):
    df = spark.createDataFrame(pairs, "true_class string, pred_class string")
    cells = M.confusion_counts(df, "true_class", "pred_class")
    return M.class_report(cells, CLASSES).orderBy("class_index").collect(), M.class_summary(cells, CLASSES).first()


def test_class_diagnostics(spark):
    true, pred = [0, 1, 1, 2, 2, 2, 3, 3], [0, 1, 3, 2, 2, 0, 3, 3]
    report, summary = diagnostics(spark, [(CLASSES[t], CLASSES[p]) for t, p in zip(true, pred)])
    matrix = [[r[f"pred_{c}"] for c in CLASSES] for r in report]
    assert matrix == [[1, 0, 0, 0], [0, 1, 0, 1], [1, 0, 2, 0], [0, 0, 0, 2]]
    assert summary["accuracy"] == pytest.approx(6 / 8, abs=1e-6)
    assert summary["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0.8 + 0.8) / 4, abs=1e-6)


def test_supported_and_all_class_f1_differ(spark):
    _, summary = diagnostics(spark, [("aerobe", "aerobe"), ("anaerobe", "anaerobe")])
    assert (summary["macro_f1"], summary["macro_f1_all_classes"]) == (1.0, 0.5)


def test_top_errors(spark):
    df = spark.createDataFrame(
        [("a", "b", 0.7, 0.2), ("a", "a", 0.9, 0.9), ("b", "a", 0.6, 0.4), ("b", "a", 0.6, 0.1)],
        "true_class string, pred_class string, confidence double, true_probability double",
    )
    got = [(r["confidence"], r["margin"]) for r in W.top_errors(df, 2).collect()]
    assert got == [(0.7, 0.5), (0.6, 0.5)]


def test_masked_loss_is_plain_mean_of_weighted_rows(spark):
    logits = [2.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame(
        [(logits, 0, 1), (logits, 1, 1), (logits, 3, 0)],
        "logits array<double>, label_oxygen_requirement int, mask_oxygen_requirement int",
    )
    got = M.masked_loss(df, numeric=(), class_weights=[1, 3, 1, 1]).first()["loss_oxygen"]
    total = math.log(math.exp(2) + 3)
    assert got == pytest.approx(((total - 2) * 1 + total * 3) / 2)


def test_masked_loss_without_rows_is_zero(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0, 0.0, 0.0], 0, 0, 5.0, 0.0, 0)],
        "logits array<double>, label_oxygen_requirement int, mask_oxygen_requirement int, pred_optimal_ph double, label_optimal_ph double, mask_optimal_ph int",
    )
    assert M.masked_loss(df, numeric=("optimal_ph",)).first()["loss"] == 0.0


def test_spearman(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=200)
    pdf = pd.DataFrame({"f_strong": y + 0.3 * rng.normal(size=200), "f_weak": y + 3 * rng.normal(size=200), "f_noise": np.round(rng.normal(size=200)), "t": y})
    pdf.loc[:20, "t"] = None
    pdf.loc[50:70, "f_weak"] = None
    pdf["f_flat"] = 1.0
    df = spark.createDataFrame(pdf)
    features = ["f_noise", "f_weak", "f_strong", "f_flat"]
    rows = M.spearman(df, features, "t", top_n=10).collect()
    assert rows[0]["feature"] == "f_strong" and abs(rows[0]["spearman_rho"]) > 0.5 and rows[0]["p_value"] < 1e-6
    assert {r["feature"] for r in rows} == set(features) - {"f_flat"}
    for r in rows:
        both = pdf[[r["feature"], "t"]].dropna().rank()
        assert r["spearman_rho"] == pytest.approx(both.corr().iloc[0, 1]) and r["n"] == len(both)
    assert M.spearman(df.limit(40), features, "t").count() == 0
    assert M.spearman(df, features, "absent").count() == 0


def test_normal_tail(one):
    for z, p in ((0.0, 1.0), (1.959963985, 0.05), (6.0, 1.973175e-9)):
        assert one(M._normal_tail(F.lit(z))) == pytest.approx(p, rel=1e-4)


def test_class_separation(spark):
    rng = np.random.default_rng(0)
    label = np.repeat(["a", "b", "c"], 40)
    centre = np.repeat([0.0, 5.0, 10.0], 40)
    df = spark.createDataFrame(pd.DataFrame({"f_useless": rng.normal(size=120), "f_separating": centre + rng.normal(size=120), "y": label}))
    rows = M.class_separation(df, ["f_useless", "f_separating"], "y").collect()
    best = max(rows, key=lambda r: r["score"])["feature"]
    means = [r["mean"] for r in rows if r["feature"] == best]
    assert best == "f_separating" and max(means) - min(means) > 5


def test_verdicts(one):
    v = lambda a, b: one(M.weak_label_verdict(F.lit(a), F.lit(b)))
    assert [v(1.0, 0.9), v(1.0, 1.1), v(1.0, 1.0005)] == ["HELPS", "HURTS", "WASH"]


def test_compare_runs(spark):
    schema = "target string, task string, value double"
    a = spark.createDataFrame([("t", "regression", 2.0), ("o", "classification", 0.0), ("p", "regression", 1.0)], schema)
    b = spark.createDataFrame([("t", "regression", 1.0), ("o", "classification", 0.1), ("p", "regression", 1.0)], schema)
    got = {r["target"]: (r["verdict"], round(r["delta_pct"], 6)) for r in M.compare_runs(a, b).collect()}
    assert got == {"t": ("better", -50.0), "o": ("better", 10000.0), "p": ("tie", 0.0)}


def test_missing_published_value_is_not_covered(spark):
    df = spark.createDataFrame(
        [(5.0, 4.0, 6.0), (None, 4.0, 6.0), (7.0, 4.0, 6.0), (6.0, 4.0, 6.0)],
        "optimal_ph double, pred_optimal_ph_low_80 double, pred_optimal_ph_high_80 double",
    )
    assert M.interval_coverage(df, ["optimal_ph"]).first()["coverage"] == 0.5
