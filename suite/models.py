"""Model training and scoring. Fitted numbers differ between tree libraries, so the oracles hold
what must be true of them: rows, folds, sizes, ranges, orders and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cultiva.operators.metrics import ab_lift
from cultiva.plans import phenotype as H
from cultiva.plans import recommender as P
from cultiva.plans.boosting import Trees
from cultiva.plans.report import baselines
from cultiva.plans.serving import describe_genomes, recommend_media
from cultiva.plans.training_table import build_training_table, with_group
from cultiva.session import materialize, shared_scratch
from suite.base import STRAINS_SQL, lines, links, query, rounded, strains, table, with_sql
from suite.media import recipes
from suite.strains import PHENOTYPES_SQL, WEAK_SQL, merged_labels, phenotypes

TREES = Trees(iterations=20, depth=4, step=0.2, bins=32)
FEATURES = ["n_orders", "top_price", "mean_price", "n_lines", "mean_quantity", "mean_discount"]
MIN_LABELS = 100
OXYGEN = "oxygen_requirement"

# Labels of the strains that have features; temperature and oxygen follow the features.
TRAINED_SQL = """
trained AS (
  SELECT p.* REPLACE (
           CASE WHEN oxygen_requirement IS NULL OR oxygen_requirement = '' THEN NULL WHEN q < 25 THEN 'anaerobe'
                WHEN q < 26 THEN 'aerobe' ELSE 'obligate aerobe' END AS oxygen_requirement),
         coalesce(nullif(family, ''), nullif(genus, ''), split_part(species, ' ', 1), '__unknown__') AS "group"
  FROM phenotypes p JOIN (
    SELECT o_custkey AS bacdive_id, avg(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
  USING (bacdive_id))
"""


def folds_sql(name: str, source: str) -> str:
    """Five greedy folds over the groups of ``source``: largest group first, to the lightest fold."""
    loads = [f"f{i}" for i in range(5)]
    lightest = f"least({', '.join(loads)})"
    added = ", ".join(
        f"f{i} + CASE WHEN {lightest} = f{i}{''.join(f' AND f{j} > f{i}' for j in range(i))} THEN n ELSE 0 END"
        for i in range(5)
    )
    return f"""
{name}_sizes AS (
  SELECT "group", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, "group") AS i FROM ({source}) GROUP BY "group"),
{name}_greedy(i, {', '.join(loads)}, fold) AS (
  SELECT 0::bigint, {', '.join(['0::bigint'] * 5)}, -1
  UNION ALL
  SELECT s.i, {added},
         CASE {lightest} {' '.join(f'WHEN f{i} THEN {i}' for i in range(4))} ELSE 4 END
  FROM {name}_greedy g JOIN {name}_sizes s ON s.i = g.i + 1),
{name} AS (
  SELECT t.*, fold FROM ({source}) t JOIN {name}_sizes USING ("group") JOIN {name}_greedy USING (i))"""


def labelled_sql(target: str) -> str:
    source = f"SELECT * FROM trained WHERE {target} IS NOT NULL"
    return with_sql("RECURSIVE " + STRAINS_SQL.strip(), PHENOTYPES_SQL, TRAINED_SQL, folds_sql("labelled", source))


def features(spark, folder):
    """Spending of a customer as genome features."""
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("bacdive_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.max("o_totalprice").alias("top_price"),
        F.avg("o_totalprice").alias("mean_price"),
    )
    per_line = (
        lines(spark, folder, "l_orderkey", "l_quantity", "l_discount")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("bacdive_id"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.avg("l_quantity").alias("mean_quantity"),
            F.avg("l_discount").alias("mean_discount"),
        )
    )
    return orders.join(per_line, "bacdive_id", "left")


def training(spark, folder):
    """Labelled strains with features; temperature and oxygen follow the spending."""
    base = with_group(phenotypes(spark, folder)).join(
        features(spark, folder).filter("mean_quantity is not null"), "bacdive_id"
    )
    quantity, known = F.col("mean_quantity"), F.coalesce(OXYGEN, F.lit("")) != ""
    oxygen = F.when(quantity < 25, "anaerobe").when(quantity < 26, "aerobe").otherwise("obligate aerobe")
    return base.withColumns(
        {
            "optimal_temperature_c": F.when(
                F.col("optimal_temperature_c").isNotNull(), F.col("mean_price") / 10000 + quantity
            ),
            OXYGEN: F.when(known, oxygen),
        }
    )


@query("training_table")
def training_table(spark, folder):
    own = features(spark, folder).join(
        phenotypes(spark, folder).select("bacdive_id", "genome_accession"), "bacdive_id"
    )
    labels = phenotypes(spark, folder).withColumns(
        {"isolation_cat1": F.concat_ws("|", "genus", "family"), "isolation_cat2": F.col("species")}
    )
    fused, names = build_training_table(labels, own, [(merged_labels(spark, folder).select("bacdive_id", F.col("optimal_ph").alias("md_ph")), "bacdive_id")])
    return rounded(fused.select("bacdive_id", "group", *FEATURES, "md_ph", F.lit(len(names)).alias("n_features")))


def fold_facts(result, df, target, task, better):
    """Sizes of every fold, and whether the mean metric beats the constant prediction."""
    constant = baselines(df, {target: task}).first()["baseline"]
    mean = F.avg("value").over(Window.partitionBy("target"))
    return result.fold_table(df).select(
        "target", "task", "fold", "metric", "n_train", "n_test",
        (F.col("value") >= 0).alias("value_ok"), better(mean, F.lit(constant)).alias("beats_constant"),
    )


def fold_facts_sql(target: str, task: str, metric: str) -> str:
    return labelled_sql(target) + f"""
SELECT '{target}' AS target, '{task}' AS task, fold, '{metric}' AS metric,
       (sum(count(*)) OVER () - count(*))::bigint AS n_train, count(*) AS n_test, true AS value_ok, true AS beats_constant
FROM labelled GROUP BY fold"""


@query("cross_validate_regression", fold_facts_sql("optimal_temperature_c", "regression", "mae"))
def cross_validate_regression(spark, folder):
    df = materialize(training(spark, folder))
    result = H.cross_validate(df, "optimal_temperature_c", "regression", FEATURES, "bacdive_id", trees=TREES)
    return fold_facts(result, df, "optimal_temperature_c", "regression", lambda a, b: a < b)


@query(
    "cross_validate_classification",
    labelled_sql(OXYGEN) + f"""
SELECT '{OXYGEN}' AS target, fold, bacdive_id::varchar AS row_id, oxygen_requirement AS observed,
       true AS known_class, true AS sums_to_one, true AS most_likely, true AS beats_majority FROM labelled""",
)
def cross_validate_classification(spark, folder):
    df = materialize(training(spark, folder))
    result = H.cross_validate(df, OXYGEN, "classification", FEATURES, "bacdive_id", trees=TREES)
    majority = baselines(df, {OXYGEN: "classification"}).first()["baseline"]
    mean = sum(f[4] for f in result.folds) / len(result.folds)
    chances, names = F.col("probabilities"), F.array(*[F.lit(c) for c in ("aerobe", "anaerobe", "obligate aerobe")])
    total = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)
    return result.prediction_table(df).select(
        "target", "fold", "row_id", "observed",
        F.array_contains(names, F.col("predicted")).alias("known_class"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.get(chances, F.array_position(names, F.col("predicted")).cast("int") - 1) == F.array_max(chances)).alias("most_likely"),
        F.lit(mean > majority).alias("beats_majority"),
    )


@query(
    "cross_validation_importances",
    "SELECT 'optimal_ph' AS target, unnest(" + str(FEATURES) + ") AS feature, true AS is_share, true AS sums_to_one",
)
def cross_validation_importances(spark, folder):
    df = materialize(training(spark, folder))
    result = H.cross_validate(df, "optimal_ph", "regression", FEATURES, "bacdive_id", trees=TREES)
    total = F.sum("importance").over(Window.partitionBy("target"))
    return result.importance_table(df).select(
        "target", "feature", F.col("importance").between(0, 1).alias("is_share"), (F.abs(total - 1) < 1e-9).alias("sums_to_one")
    )


@query(
    "interval_heads",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL, TRAINED_SQL, f"""
counted AS (
  SELECT count(*) FILTER (optimal_temperature_c IS NOT NULL AND bacdive_id % 5 <> 0) AS n_fit,
         count(*) FILTER (optimal_temperature_c IS NOT NULL AND bacdive_id % 5 = 0) AS n_held_out FROM trained)""")
    + f"""SELECT n_fit, n_held_out, n_fit >= {MIN_LABELS} AS in_order, n_fit >= {MIN_LABELS} AS several_widths,
       n_fit >= {MIN_LABELS} AS covers FROM counted""",
)
def interval_heads(spark, folder):
    """Intervals of strains that took no part in the fit."""
    target = "optimal_temperature_c"
    df = materialize(training(spark, folder).filter(F.col(target).isNotNull()))
    apart = F.col("bacdive_id") % 5 == 0
    heads = H.fit_heads(df.filter(~apart), FEATURES, "bacdive_id", {target: "regression"}, TREES, minimum=MIN_LABELS)
    scored = H.predict_targets(df, heads.features, heads, ["bacdive_id", target])
    name = f"pred_{target}"
    counts = [F.count_if(~apart).alias("n_fit"), F.count_if(apart).alias("n_held_out")]
    if not heads.heads:
        return scored.agg(*counts, *[F.lit(False).alias(c) for c in ("in_order", "several_widths", "covers")])
    low, high = F.col(f"{name}_low_80"), F.col(f"{name}_high_80")
    inside = F.avg(F.when(apart, F.col(target).between(low, high).cast("double")))
    return scored.agg(
        *counts,
        F.every((low <= F.col(name)) & (F.col(name) <= high)).alias("in_order"),
        (F.count_distinct(F.round(high - low, 6)) > 1).alias("several_widths"),
        inside.between(0.7, 0.9).alias("covers"),
    )


@query(
    "predict_all_targets",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL, TRAINED_SQL, f"""
fitted AS (
  SELECT (count(optimal_temperature_c) >= {MIN_LABELS})::int + (count(optimal_ph) >= {MIN_LABELS})::int
       + (count(oxygen_requirement) >= {MIN_LABELS})::int + (count(salt_tolerance_pct) >= {MIN_LABELS})::int AS n_targets
  FROM trained)""")
    + """SELECT bacdive_id, 1::bigint AS n_contigs, n_targets, true AS in_order, true AS is_share, true AS same_after_load,
       true AS order_checked FROM trained, fitted""",
)
def predict_all_targets(spark, folder):
    """All heads with intervals, stored, read by a fresh object, and held against those in memory."""
    df = materialize(training(spark, folder))
    heads = H.fit_heads(df, FEATURES, "bacdive_id", trees=TREES, minimum=MIN_LABELS)
    genomes = df.withColumns(
        {"n_contigs": F.lit(1.0), "n_predicted_cds": F.col("n_lines"), "gc_content": F.col("mean_discount")}
    )
    loaded, refused = heads, True
    if heads.heads:
        place = shared_scratch(spark)
        H.save_heads(spark, heads, place)
        loaded = H.load_heads(spark, place, FEATURES)
        try:
            H.load_heads(spark, place, FEATURES[::-1])
            refused = False
        except ValueError:
            pass
    first, again = (describe_genomes(genomes, h.features, h, "bacdive_id") for h in (heads, loaded))
    names = [c for c in first.columns if c.startswith("pred_")]
    both = first.join(again.select("bacdive_id", F.struct(*again.columns).alias("again")), "bacdive_id")
    order, share = F.lit(True), F.lit(True)
    for c in names:
        if c.endswith("_low_80"):
            middle = c.removesuffix("_low_80")
            order = order & (F.col(c) <= F.col(middle)) & (F.col(middle) <= F.col(f"{middle}_high_80"))
        if c.endswith("_confidence"):
            share = share & F.col(c).between(1 / 3, 1)
    return both.select(
        "bacdive_id", "n_contigs", F.lit(len(heads.heads)).alias("n_targets"), order.alias("in_order"), share.alias("is_share"),
        (F.struct(*first.columns) == F.col("again")).alias("same_after_load"), F.lit(refused).alias("order_checked"),
    )


@query(
    "feature_lift",
    "SELECT 'optimal_temperature_c' AS target, 'regression' AS task, 'better' AS verdict",
)
def feature_lift(spark, folder):
    df = materialize(training(spark, folder))
    first, second = H.feature_lift(
        df, "optimal_temperature_c", "regression", FEATURES[:1], FEATURES, "bacdive_id", trees=TREES
    )
    return ab_lift(first, second).select("target", "task", "verdict")


WEAK_FOLDS_SQL = with_sql(
    "RECURSIVE " + STRAINS_SQL.strip(), PHENOTYPES_SQL, WEAK_SQL, TRAINED_SQL,
    folds_sql("labelled", """SELECT t.bacdive_id, "group", m.optimal_ph_source = 'bacdive' AS curated
FROM trained t JOIN merged m USING (bacdive_id) WHERE m.optimal_ph IS NOT NULL"""),
    """
per_fold AS (SELECT fold, count(*) AS n, count_if(curated) AS c FROM labelled GROUP BY fold),
used AS (
  SELECT c, (SELECT sum(c) FROM per_fold) - c >= 100 AND c >= 50 AS strict,
         (SELECT sum(n) FROM per_fold) - n >= 100 AND c >= 50 AS wide FROM per_fold)""",
)


@query(
    "weak_label_test",
    WEAK_FOLDS_SQL + """SELECT 'optimal_ph' AS target,
  greatest(sum(c) FILTER (strict), sum(c) FILTER (wide))::bigint AS n_eval,
  CASE WHEN bool_or(strict) AND bool_or(wide) THEN true END AS judged FROM used""",
)
def weak_label_test(spark, folder):
    df = training(spark, folder).drop("optimal_ph").join(
        merged_labels(spark, folder).select("bacdive_id", "optimal_ph", "optimal_ph_source"), "bacdive_id"
    )
    found = H.weak_label_test(materialize(df), "optimal_ph", FEATURES, "bacdive_id", trees=TREES)
    return found.select("target", "n_eval", F.col("verdict").isin("HELPS", "HURTS", "WASH").alias("judged"))


def type_links(spark, folder):
    """Links to part types, so that few media have many strains."""
    kinds = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("medium_id"))
    return links(spark, folder).drop("medium_id").join(kinds, "p_partkey")


def type_names(spark, folder):
    """Names of most part types; those ending in R are left unnamed."""
    kinds = table(spark, folder, "part").select(F.col("p_type").alias("medium_id")).distinct()
    return kinds.filter(~F.col("medium_id").endswith("R")).withColumn("name", F.concat("medium_id", F.lit(" agar")))


def recommender(spark, folder):
    folded, positives, media = P.prepare(strains(spark, folder), type_links(spark, folder), 10)
    names = [row[0] for row in media.select("medium_id").orderBy("medium_id").collect()]
    return P.benchmark_table(folded, positives, features(spark, folder), FEATURES, names), names


MEDIA_FOLDS_SQL = with_sql(
    "RECURSIVE " + STRAINS_SQL.strip(),
    """
tlinks AS (
  SELECT o_custkey AS bacdive_id, p_type AS medium_id, l_quantity >= 46 AS yes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE o_custkey IN (SELECT bacdive_id FROM strains)),
tmedia AS (SELECT medium_id FROM tlinks WHERE yes GROUP BY medium_id HAVING count(*) >= 10),
tpositives AS (SELECT DISTINCT bacdive_id, medium_id FROM tlinks WHERE yes AND medium_id IN (SELECT medium_id FROM tmedia))""",
    folds_sql("folded", """SELECT *, coalesce(nullif(family, ''), nullif(genus, ''), nullif(species, ''), '__unknown__') AS "group"
FROM strains WHERE bacdive_id IN (SELECT bacdive_id FROM tlinks)"""),
    """
fold_n AS (SELECT fold, count(*) AS n FROM folded GROUP BY fold),
grid AS (
  SELECT fold, medium_id, n, (SELECT count(*) FROM folded) - n AS n_train,
         (SELECT count(*) FROM tpositives p JOIN folded f USING (bacdive_id) WHERE p.medium_id = m.medium_id AND f.fold = fold_n.fold) AS pos,
         (SELECT count(*) FROM tpositives p WHERE p.medium_id = m.medium_id) AS all_pos
  FROM fold_n, tmedia m)""",
)


@query(
    "per_medium_cross_validation",
    MEDIA_FOLDS_SQL + """SELECT medium_id, fold, n_train::bigint AS n_train, n AS n_test, pos AS n_test_positives, true AS roc_ok, true AS pr_ok
FROM grid WHERE all_pos - pos >= 5 AND all_pos - pos < n_train AND pos >= 1 AND pos < n""",
)
def per_medium_cross_validation(spark, folder):
    data, media = recommender(spark, folder)
    found = P.train_per_medium(data, media, FEATURES, trees=TREES)
    return found.select(
        "medium_id", "fold", "n_train", "n_test", "n_test_positives",
        F.col("roc_auc").between(0, 1).alias("roc_ok"), ((F.col("pr_auc") > 0) & (F.col("pr_auc") <= 1)).alias("pr_ok"),
    )


@query(
    "model_benchmark",
    MEDIA_FOLDS_SQL + """SELECT count(DISTINCT bacdive_id) AS n_eval,
  round(count(*) / count(DISTINCT bacdive_id), 6) AS mean_true_media, true AS hits_grow, true AS recall_grows, true AS ranks_ok
FROM tpositives""",
)
def model_benchmark(spark, folder):
    data, media = recommender(spark, folder)
    found = P.model_benchmark(P.fold_scores(data, media, FEATURES, trees=TREES))

    def grows(name):
        one, three, five = (F.col(f"{name}_at_{k}") for k in (1, 3, 5))
        return (one >= 0) & (one <= three) & (three <= five) & (five <= 1)

    return found.select(
        "n_eval", F.round("mean_true_media", 6).alias("mean_true_media"), grows("hit").alias("hits_grow"),
        grows("recall").alias("recall_grows"), ((F.col("mrr") >= F.col("hit_at_1")) & (F.col("mrr") <= 1)).alias("ranks_ok"),
    )


SERVED_SQL = MEDIA_FOLDS_SQL.rstrip() + """,
served AS (
  SELECT count(*) AS n_media FROM (SELECT count(*) AS pos FROM tpositives GROUP BY medium_id)
  WHERE pos >= 10 AND (SELECT count(*) FROM folded) - pos >= 10),
genomes AS (SELECT DISTINCT o_custkey AS bacdive_id FROM orders)
"""


@query(
    "production_models_top_media",
    SERVED_SQL + """SELECT bacdive_id, least(3, n_media)::int AS n_listed, true AS falls, true AS is_share, true AS named
FROM genomes, served""",
)
def production_models_top_media(spark, folder):
    """Top media by models that were stored and read again."""
    data, media = recommender(spark, folder)
    models = P.train_production(data, media, FEATURES, TREES)
    genomes = features(spark, folder)
    truths = [F.lit(True).alias(c) for c in ("falls", "is_share", "named")]
    if models is None:
        return genomes.select("bacdive_id", F.lit(0).alias("n_listed"), *truths)
    place = shared_scratch(spark)
    P.save_models(spark, models, place)
    top = P.top_media(genomes, P.load_models(spark, place), {m: m.title() for m in media}, "bacdive_id")
    ids, scores = [F.col(f"top{i}_medium_id") for i in (1, 2, 3)], [F.col(f"top{i}_confidence") for i in (1, 2, 3)]
    falls = F.coalesce((scores[0] >= scores[1]) & (scores[1] >= scores[2]), F.lit(True))
    share, named = F.lit(True), F.lit(True)
    for i in range(3):
        share = share & F.coalesce(scores[i].between(0, 1), ids[i].isNull())
        titles = F.create_map(*[F.lit(x) for m in media for x in (m, m.title())])
        named = named & F.coalesce(F.col(f"top{i + 1}_medium_name") == titles[ids[i]], ids[i].isNull())
    listed = F.size(F.array_distinct(F.array_compact(F.array(*ids))))
    return top.select(
        "bacdive_id", listed.alias("n_listed"), falls.alias("falls"), share.alias("is_share"), named.alias("named")
    )


@query(
    "recommend_with_recipes",
    SERVED_SQL + """SELECT bacdive_id, unnest(range(1, least(5, n_media) + 1))::int AS rank, true AS named, true AS has_recipe, true AS is_share
FROM genomes, served""",
)
def recommend_with_recipes(spark, folder):
    data, media = recommender(spark, folder)
    models = P.train_production(data, media, FEATURES, TREES)
    genomes = features(spark, folder)
    if models is None:
        return genomes.limit(0).select("bacdive_id", F.lit(1).alias("rank"), *[F.lit(True).alias(c) for c in ("named", "has_recipe", "is_share")])
    found = recommend_media(genomes, models, type_names(spark, folder), recipes(spark, folder, "p_type"), 5, "bacdive_id")
    medium = F.col("medium_id")
    own = F.when(medium.endswith("R"), "(unknown)").otherwise(F.concat(medium, F.lit(" agar")))
    return found.select(
        "bacdive_id", "rank", (F.col("name") == own).alias("named"), (F.col("recipe") != "").alias("has_recipe"),
        F.col("confidence").between(0, 1).alias("is_share"),
    )
