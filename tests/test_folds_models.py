import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cultiva.operators.folds import dealing_plan, fold_of_groups, group_folds, random_fold
from cultiva.operators.metrics import constant_mean_mae
from cultiva.plans import boosting
from cultiva.plans import phenotype as H
from cultiva.plans import recommender as P
from cultiva.plans import report
from cultiva.plans.boosting import Ensemble, Model, Trees, best_split, binned, fit, with_scores
from cultiva.plans.training_table import with_group

TREES = Trees(iterations=8, depth=3, step=0.4, bins=32)


def test_groups_stay_together_and_balance(spark):
    sizes = {"hot": 50, **{f"g{i:02d}": 5 for i in range(20)}, None: 7}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    folds = fold_of_groups(df, "g", 5).collect()
    assert len(folds) == len({r["g"] for r in folds}) == len(sizes)
    load = {}
    for r in folds:
        load[r["fold"]] = load.get(r["fold"], 0) + sizes[r["g"]]
    assert sorted(load) == [0, 1, 2, 3, 4] and sorted(load.values())[-2] - sorted(load.values())[0] <= 7


def test_two_groups_give_two_folds(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "g string")
    assert {r["fold"] for r in group_folds(df, "g", 5).collect()} == {0, 1}


@pytest.mark.parametrize("sizes", [{1: 9}, {3: 1, 1: 12}, {50: 1, 7: 5, 2: 3, 1: 40}, {4: 2, 3: 3}])
@pytest.mark.parametrize("k", [2, 3, 5])
def test_dealing_plan_is_the_greedy_rule(sizes, k):
    load, want = [0] * k, []
    for size in sorted(sizes, reverse=True):
        for i in range(sizes[size]):
            fold = min(range(k), key=lambda f: (load[f], f))
            load[fold] += size
            want.append((size, i, fold))
    plan = dealing_plan(list(sizes.items()), k)
    got = [(s, first + i, turn[i % len(turn)]) for s, first, n, turn in plan for i in range(n)]
    assert got == want


def test_random_folds_ignore_partitioning(spark):
    df = spark.range(1000)
    a = {r["id"]: r["f"] for r in df.select("id", random_fold(F.col("id"), 5, 1).alias("f")).collect()}
    b = {r["id"]: r["f"] for r in df.repartition(7).select("id", random_fold(F.col("id"), 5, 1).alias("f")).collect()}
    assert a == b and min(pd.Series(a).value_counts()) > 150


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({f"f{i}": rng.normal(size=n) for i in range(4)})
    pdf["bacdive_id"] = np.arange(n)
    pdf["family"] = [f"F{i % 12}" for i in range(n)]
    pdf["genus"] = [f"G{i % 30}" for i in range(n)]
    pdf["species"] = "x y"
    pdf["optimal_temperature_c"] = 30 + 8 * pdf["f0"] + rng.normal(size=n)
    pdf["optimal_ph"] = np.where(rng.random(n) < 0.3, np.nan, 7 + pdf["f1"])
    labels = np.where(pdf["f2"] > 0, "aerobe", "anaerobe").astype(object)
    labels[:2] = "rare"
    pdf["oxygen_requirement"] = labels
    df = with_group(spark.createDataFrame(pdf))
    return df.withColumn("optimal_ph", F.when(~F.isnan("optimal_ph"), F.col("optimal_ph"))).persist()


FEATURES = ["f0", "f1", "f2", "f3"]


def test_regression_beats_constant(training):
    result = H.cross_validate(training, "optimal_temperature_c", "regression", FEATURES, "bacdive_id", trees=TREES, k=3)
    folds = result.fold_table(training).toPandas()
    assert len(folds) == 3 and folds["n_test"].sum() == 300
    assert folds["value"].mean() < constant_mean_mae(training, "optimal_temperature_c").first()["mae"]
    best = result.importance_table(training).orderBy(F.col("importance").desc()).first()
    assert best["feature"] == "f0"
    predictions = result.prediction_table(training)
    assert predictions.count() == 300 and set(predictions.columns) == {"target", "task", "fold", "row_id", "predicted", "observed"}
    sections = report.report(training, result.fold_table(training), predictions, training, FEATURES, "bacdive_id")
    summary = {r["target"]: r for r in sections["summary"].collect()}
    assert summary["optimal_temperature_c"]["improvement_pct"] > 0 and summary["optimal_ph"]["value"] is None
    assert sections["correlations_optimal_temperature_c"].first()["feature"] == "f0"
    assert sections["family_errors_optimal_temperature_c"].count() == 12


def test_classification_with_rare_class(training):
    result = H.cross_validate(training, "oxygen_requirement", "classification", FEATURES, "bacdive_id", trees=TREES, k=3)
    assert all(f[4] > 0.4 for f in result.folds)


def test_too_few_rows(training):
    assert not H.cross_validate(training.limit(3), "optimal_ph", "regression", FEATURES, "bacdive_id").folds


def test_heads_give_intervals(training, spark, tmp_path):
    targets = {"optimal_temperature_c": "regression", "oxygen_requirement": "classification", "salt_tolerance_pct": "regression"}
    heads = H.fit_heads(training, FEATURES, "bacdive_id", targets, TREES, k=3)
    assert [h.target for h in heads.heads] == ["optimal_temperature_c", "oxygen_requirement"]
    rows = H.predict_targets(training, FEATURES, heads, ["bacdive_id", "optimal_temperature_c"]).toPandas()
    low, high = rows["pred_optimal_temperature_c_low_80"], rows["pred_optimal_temperature_c_high_80"]
    assert 0.7 < rows["optimal_temperature_c"].between(low, high).mean() <= 1.0
    assert rows["pred_optimal_temperature_c"].between(low, high).all() and (high - low).round(6).nunique() > 1
    assert rows["pred_oxygen_requirement_confidence"].between(0, 1).all()
    assert set(rows["pred_oxygen_requirement"]) <= {"aerobe", "anaerobe", "rare"}
    H.save_heads(spark, heads, f"{tmp_path}/heads")
    loaded = H.load_heads(spark, f"{tmp_path}/heads", FEATURES)
    again = H.predict_targets(training, FEATURES, loaded, ["bacdive_id", "optimal_temperature_c"]).toPandas()
    pd.testing.assert_frame_equal(rows.sort_values("bacdive_id", ignore_index=True), again.sort_values("bacdive_id", ignore_index=True))
    with pytest.raises(ValueError):
        H.load_heads(spark, f"{tmp_path}/heads", FEATURES[::-1])
    with pytest.raises(ValueError):
        H.predict_targets(training, FEATURES[::-1], loaded, ["bacdive_id"])
    with pytest.raises(ValueError):
        H.predict_targets(training.drop("f1"), FEATURES, loaded, ["bacdive_id"]).count()
    spark.read.parquet(f"{tmp_path}/heads/trees").limit(3).write.parquet(f"{tmp_path}/short")
    spark.read.parquet(f"{tmp_path}/short").write.mode("overwrite").parquet(f"{tmp_path}/heads/trees")
    with pytest.raises(ValueError):
        H.load_heads(spark, f"{tmp_path}/heads")


def test_intervals_widen_with_the_noise(spark):
    """Strains with a large second feature scatter ten times as much."""
    rng = np.random.default_rng(4)
    n = 800
    wide = rng.random(n) < 0.5
    pdf = pd.DataFrame({"f0": rng.normal(size=n), "f1": wide * 1.0, "bacdive_id": np.arange(n), "group": [f"g{i % 40}" for i in range(n)]})
    pdf["optimal_temperature_c"] = 30 + 2 * pdf["f0"] + rng.normal(size=n) * np.where(wide, 10.0, 1.0)
    df = spark.createDataFrame(pdf)
    heads = H.fit_heads(df, ["f0", "f1"], "bacdive_id", {"optimal_temperature_c": "regression"}, TREES)
    rows = H.predict_targets(df, ["f0", "f1"], heads, ["f1"]).toPandas()
    width = (rows["pred_optimal_temperature_c_high_80"] - rows["pred_optimal_temperature_c_low_80"]).groupby(rows["f1"]).mean()
    assert width[1.0] > 4 * width[0.0]


def test_all_targets_in_one_run(training):
    together = H.cross_validate_all(training, FEATURES, "bacdive_id", k=3, trees=TREES)
    alone = H.cross_validate(training, "optimal_ph", "regression", FEATURES, "bacdive_id", k=3, trees=TREES)
    mine = [f for f in together.folds if f[0] == "optimal_ph"]
    assert {f[0] for f in together.folds} == {"optimal_temperature_c", "optimal_ph", "oxygen_requirement"}
    # Targets share bins, found over the rows of all of them; folds and sizes are the target's own.
    assert [f[:4] + f[5:] for f in mine] == [f[:4] + f[5:] for f in alone.folds]
    assert abs(np.mean([f[4] for f in mine]) - np.mean([f[4] for f in alone.folds])) < 0.1


def test_weak_labels_and_guards(training, spark):
    df = training.withColumn(
        "optimal_ph_source", F.when(F.col("bacdive_id") % 3 == 0, "mediadive_weak").otherwise("bacdive")
    )
    row = H.weak_label_test(df, "optimal_ph", FEATURES, "bacdive_id", min_train=20, min_test=5, k=3, trees=TREES).first()
    assert row["verdict"] in ("HELPS", "HURTS", "WASH") and row["n_eval"] == df.filter("optimal_ph is not null and optimal_ph_source = 'bacdive'").count()
    guarded = H.weak_label_test(df, "optimal_ph", FEATURES, "bacdive_id", min_train=10_000, k=3, trees=TREES).first()
    assert guarded["verdict"] is None and guarded["n_eval"] is None


def brute_split(bins, g, h, width, l2, least):
    """Best gain over all features, thresholds and sides of the missing values."""
    best = 0.0
    for f in range(bins.shape[1]):
        for t in range(1, width):
            for missing_left in (True, False):
                left = (bins[:, f] <= t) & ((bins[:, f] > 0) | missing_left)
                (a, b), (c, d) = (g[left].sum(), h[left].sum()), (g[~left].sum(), h[~left].sum())
                if b >= least and d >= least:
                    best = max(best, a * a / (b + l2) + c * c / (d + l2) - (a + c) ** 2 / (b + d + l2))
    return best


def test_best_split_against_all_splits():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n, width = 40, 6
        bins, g, h = rng.integers(0, width, (n, 3)), rng.normal(size=n), rng.random(n)
        sums = np.zeros((3, width, 2))
        for f in range(3):
            np.add.at(sums[f], bins[:, f], np.stack([g, h], axis=1))
        found = best_split(sums, 1.0, 2.0)
        assert found[3] == pytest.approx(max(0.0, brute_split(bins, g, h, width, 1.0, 2.0)), abs=1e-9)
        if found[3] > 0:
            left = (bins[:, found[0]] <= found[1]) & ((bins[:, found[0]] > 0) | found[2])
            assert found[4] == pytest.approx(g[left].sum()) and found[7] == pytest.approx(h[~left].sum())


def grown(rng, models, depth, width, n_features):
    nodes = (1 << depth) - 1
    return Ensemble(
        [f"f{i}" for i in range(n_features)], [np.zeros(0)] * n_features, models, depth,
        rng.integers(0, n_features, (len(models), 2, nodes)), rng.integers(1, width, (len(models), 2, nodes)),
        rng.random((len(models), 2, nodes)) < 0.5, np.zeros((len(models), 2, nodes)),
        rng.normal(size=(len(models), 2, nodes + 1)).astype(np.float32),
    )


@pytest.mark.parametrize("held", [boosting.HELD, 0])
def test_a_task_adds_up_all_its_rows(monkeypatch, held):
    rng, width, level = np.random.default_rng(3), 9, 2
    models = [Model("a", 0, "squared", 0, 1), Model("b", 1, "binary", 1, 2, weight=3.0), Model("c", 1, "binary", 2)]
    pending, tree = grown(rng, models, 3, width, 4), grown(rng, models, 3, width, 4)
    growing = (tree.feature[:, 0], tree.bin[:, 0], tree.missing_left[:, 0])
    bins, n = rng.integers(0, width, (600, 4)).astype(np.uint8), 600
    labels = np.stack([rng.normal(size=n), rng.integers(0, 2, n)], axis=1).astype(float)
    labels[::7, 0] = np.nan
    folds, scores = rng.integers(0, 3, (n, 1)), rng.normal(size=(n, 3)).astype(np.float32)

    def leaf(x, features, cuts, missing_left, depth):
        node = 0
        for d in range(depth):
            at = (1 << d) - 1 + node
            v = x[features[at]]
            node = 2 * node + int(not missing_left[at] if v == 0 else v > cuts[at])
        return node

    expected = {}
    for r in range(n):
        for i, m in enumerate(models):
            y = labels[r, m.label]
            if np.isnan(y) or folds[r, 0] == m.held_out:
                continue
            s = scores[r, i]
            for t in range(2):
                s = s + pending.leaf[i, t, leaf(bins[r], pending.feature[i, t], pending.bin[i, t], pending.missing_left[i, t], 3)]
            w, p = (m.weight if y == 1 else 1.0), 1 / (1 + np.exp(-float(s)))
            g, h = (float(s) - y, 1.0) if m.kind == "squared" else (w * (p - y), w * p * (1 - p))
            cells = expected.setdefault((i, leaf(bins[r], *(c[i] for c in growing), level)), np.zeros((4, width, 2)))
            for f in range(4):
                cells[f, bins[r, f]] += g, h
    monkeypatch.setattr(boosting, "ROWS", 100)
    monkeypatch.setattr(boosting, "HELD", held)
    batches = pa.table({
        "_labels": boosting._binary(labels), "_folds": boosting._binary(folds),
        "_bins": boosting._binary(bins), "_scores": boosting._binary(scores),
    }).to_batches(max_chunksize=50)
    found, records = {}, 0
    for batch in boosting._histograms(iter(batches), pending, growing, level, width):
        sums = boosting._raw(batch.column("sums"), 4 * width * 2, np.float64)
        for model, node, row in zip(batch.column("model").to_pylist(), batch.column("node").to_pylist(), sums):
            found[model, node] = found.get((model, node), 0) + row.reshape(4, width, 2)
            records += 1
    assert found.keys() == expected.keys()
    for key, cells in expected.items():
        np.testing.assert_allclose(found[key], cells, rtol=1e-4, atol=1e-4)
    assert records == len(expected) or not held


def test_bins():
    x = np.array([[1.0], [2.0], [2.5], [np.nan], [9.0]])
    assert binned(x, [np.array([1.0, 2.0, 3.0])]).ravel().tolist() == [1, 2, 3, 0, 4]
    assert binned(x, [np.array([])]).ravel().tolist() == [1, 1, 1, 0, 1]


def test_absence_carries_the_label(spark):
    """Half of a feature is missing, and that alone separates the classes."""
    rng = np.random.default_rng(1)
    n = 400
    gone = rng.random(n) < 0.5
    pdf = pd.DataFrame({"f0": rng.normal(size=n), "f1": np.where(gone, np.nan, rng.normal(size=n)), "y": gone * 1.0, "fold": np.arange(n) % 2, "id": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("f0", F.when(F.col("id") % 5 != 0, F.col("f0")))
    models = [Model("gone", 0, "binary", f, held_out=f) for f in (0, 1)]
    found = fit(df, ["f0", "f1"], [F.col("y")], models, TREES, [F.col("fold")], ["id", "y"])
    rows = found.held_out(["id", "y"]).toPandas()
    assert len(rows) == n and ((rows["scores"].str[0] > 0.5) == (rows["y"] == 1)).all()
    again = with_scores(df, found.ensemble).toPandas()
    both = rows.merge(again, on="id")
    mine = [s[f] for s, f in zip(both["_scores"], both["fold_x"])]
    np.testing.assert_allclose(both["scores"].str[0], mine, atol=1e-5)


def test_models_grown_together_are_those_grown_alone(training):
    df = training.withColumn("grown", (F.col("f2") > 0).cast("double")).withColumn("fold", F.col("bacdive_id") % 2)
    models = [Model("a", 0, "binary", 0, held_out=0), Model("b", 1, "squared", 1, held_out=1, base=30.0)]
    labels, size = [F.col("grown"), F.col("optimal_temperature_c")], Trees(iterations=9, depth=2, step=0.3, bins=16)
    together = fit(df, FEATURES, labels, models, size, [F.col("fold")]).ensemble
    for i, m in enumerate(models):
        alone = fit(df, FEATURES, labels, [m], size, [F.col("fold")]).ensemble
        np.testing.assert_array_equal(alone.feature[0], together.feature[i])
        np.testing.assert_allclose(alone.leaf[0], together.leaf[i], rtol=1e-4, atol=1e-6)


def test_recommender(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 300
    f = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(f, columns=["f0", "f1", "f2"]).assign(bacdive_id=np.arange(n))
    grows = {"A": f[:, 0] > 0.3, "B": f[:, 0] < -0.3, "C": rng.random(n) < 0.5}
    links = [(int(i), m, "yes") for m, g in grows.items() for i in np.flatnonzero(g)]
    links += [(i, "D", "yes") for i in range(3)] + [(i, "D", "no") for i in range(n)]
    tax = spark.createDataFrame(
        [(i, f"F{i % 10}", f"G{i % 30}", "s p") for i in range(n)], "bacdive_id bigint, family string, genus string, species string"
    )
    link_table = spark.createDataFrame(links, "bacdive_id bigint, medium_id string, growth string")
    folded, positives, media = P.prepare(tax, link_table, minimum=50, k=2)
    names = sorted(r["medium_id"] for r in media.collect())
    assert names == ["A", "B", "C"] and folded.count() == n
    features = ["f0", "f1", "f2"]
    table = P.benchmark_table(folded, positives, spark.createDataFrame(pdf), features, names)
    found = P.train_per_medium(table, names, features, trees=TREES).toPandas()
    auc = found.groupby("medium_id")["roc_auc"].mean()
    assert len(found) == 6 and auc["A"] > 0.6 and auc["B"] > 0.6
    scores = P.fold_scores(table, names, features, trees=TREES, minimum=5).toPandas()
    assert len(scores) == 3 * n and scores["score"].between(0, 1).all()
    plain = P.fold_scores(table, names, features, trees=TREES, minimum=10_000).toPandas()
    assert plain.groupby(["fold", "medium_id"])["score"].nunique().eq(1).all() and len(plain) == 3 * n
    models = P.train_production(table, names, features, TREES)
    assert P.train_production(table, names, features, TREES, minimum=10_000) is None
    P.save_models(spark, models, f"{tmp_path}/models")
    loaded = P.load_models(spark, f"{tmp_path}/models")
    assert loaded.features == features and [m.name for m in loaded.models] == names
    genomes = table.select("bacdive_id", *features)
    long = P.score_all_media(genomes, loaded, ["bacdive_id"]).toPandas()
    assert len(long) == 3 * n and long["score"].between(0, 1).all()
    top = P.top_media(genomes, loaded, {"A": "Agar A"}, "bacdive_id").toPandas().set_index("bacdive_id")
    best = long.sort_values(["score", "medium_id"], ascending=[False, True]).groupby("bacdive_id").first()
    assert (top["top1_medium_id"].sort_index() == best["medium_id"]).all()
    assert set(top["top1_medium_name"]) <= {"Agar A", "(unknown)"}


def test_a_study_parses_every_document_once(spark):
    from cultiva.plans import study
    from cultiva.sources.documents import parse_documents

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return (
            f'{{"General":{{"BacDive-ID":{i}}},"Physiology and metabolism":{{"oxygen tolerance":[{{"oxygen tolerance":"aerobe"}}]}},'
            '"Isolation, sampling and environmental information":{"isolation source categories":[{"Cat1":"#Env","Cat2":"#Soil"}]}}'
        )

    texts = spark.range(30).select(F.col("id").alias("bacdive_id"), text.asNondeterministic()("id").alias("value"))
    features = spark.range(30).selectExpr("id AS bacdive_id", "concat('A', id) AS genome_accession", "id / 40.0D AS gc_content")
    study.prepare(parse_documents(texts), features)
    assert seen.value == 30
