"""Regression, classification, exploration and comparison metrics."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from cultiva.operators import aggregates as A
from cultiva.operators import metrics as M
from cultiva.operators import ranking as W
from cultiva.operators.encode import labels_with_mask
from cultiva.operators.filters import require_labels
from cultiva.operators.ordered import fractional_ranks, grouped_quantiles
from cultiva.plans import report
from suite.base import lines, query, r, rounded, table, with_sql
from suite.encoders import IMPORTANCE_SQL, importances
from suite.strains import PHENOTYPES, phenotypes

# Predictions: order lines of a supplier; price over quantity predicts price.
PREDICTIONS_SQL = """
predictions AS (
  SELECT CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE n_name END AS family, l_quantity * 1500 AS predicted, l_extendedprice AS observed, l_returnflag, l_linenumber
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def predictions(spark, folder):
    needed = ("l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber")
    return (
        lines(spark, folder, *needed)
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.when(F.col("s_suppkey") % 6 != 0, F.col("n_name")).alias("family"),
            (F.col("l_quantity") * 1500).alias("predicted"),
            F.col("l_extendedprice").alias("observed"),
            "l_returnflag",
            "l_linenumber",
        )
    )


@query(
    "error_by_family",
    with_sql(PREDICTIONS_SQL)
    + f"""SELECT family, count(*) AS n, {r('avg(abs(predicted - observed))', 4)} AS mae FROM predictions GROUP BY family ORDER BY n DESC, family NULLS LAST LIMIT 15""",
)
def error_by_family(spark, folder):
    return rounded(A.error_by_group(predictions(spark, folder)), 4)


@query(
    "mae_per_group",
    with_sql(PREDICTIONS_SQL) + f"SELECT l_returnflag, {r('avg(abs(predicted - observed))', 4)} AS mae FROM predictions GROUP BY l_returnflag",
)
def mae_per_group(spark, folder):
    df = predictions(spark, folder)
    return rounded(
        df.groupBy("l_returnflag").agg(M.mean_absolute_error(F.col("predicted"), F.col("observed")).alias("mae")), 4
    )


@query(
    "constant_mean_mae",
    f"SELECT count(*) AS n, {r('avg(abs(l_extendedprice - m))', 4)} AS mae FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)",
)
def constant_mean_mae(spark, folder):
    return rounded(M.constant_mean_mae(table(spark, folder, "lineitem"), "l_extendedprice"), 4)


@query(
    "constant_mean_mae_by_group",
    f"""SELECT l_returnflag, count(*) AS n, {r('avg(abs(l_extendedprice - m))', 4)} AS mae FROM lineitem
JOIN (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""",
)
def constant_mean_mae_by_group(spark, folder):
    return rounded(
        M.constant_mean_mae(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4
    )


@query(
    "describe_target",
    f"""SELECT count(*) AS n, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS std, count(*) FILTER (WHERE value >= 50) AS n_ge_50,
  count(*) FILTER (WHERE value <= 15) AS n_le_15, {r('quantile_cont(value, 0.1)', 4)} AS p10, {r('median(value)', 4)} AS median, {r('quantile_cont(value, 0.9)', 4)} AS p90 FROM events""",
)
def describe_target(spark, folder):
    return rounded(A.describe_target(table(spark, folder, "events"), "value"), 4)


@query(
    "describe_target_by_type",
    f"""SELECT event_type, count(*) AS n, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS std, count(*) FILTER (WHERE value >= 50) AS n_ge_50,
  count(*) FILTER (WHERE value <= 15) AS n_le_15, {r('quantile_cont(value, 0.1)', 4)} AS p10, {r('median(value)', 4)} AS median, {r('quantile_cont(value, 0.9)', 4)} AS p90 FROM events GROUP BY event_type""",
)
def describe_target_by_type(spark, folder):
    return rounded(A.describe_target(table(spark, folder, "events"), "value", ["event_type"]), 4)


@query(
    "grouped_quantiles",
    f"""SELECT l_returnflag, l_linestatus, {r('quantile_cont(l_extendedprice, 0.25)', 4)} AS q25, {r('quantile_cont(l_extendedprice, 0.5)', 4)} AS q50,
  {r('quantile_cont(l_extendedprice, 0.99)', 4)} AS q99 FROM lineitem GROUP BY ALL""",
)
def grouped_quantiles_query(spark, folder):
    return rounded(
        grouped_quantiles(
            table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
            {"q25": 0.25, "q50": 0.5, "q99": 0.99},
        ),
        4,
    )


@query(
    "fractional_ranks",
    """SELECT l_returnflag, l_quantity, count(*) AS n, min(rk) + (count(*) - 1) / 2.0 AS rank FROM (
  SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)::double AS rk FROM lineitem) GROUP BY ALL""",
)
def fractional_ranks_query(spark, folder):
    return fractional_ranks(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity")


# Classes: status of an order, predicted from its price.
CLASS_SQL = """
classed AS (
  SELECT o_orderkey, o_orderstatus AS true_class, CASE WHEN o_totalprice < 120000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'X' END AS pred_class,
         (o_totalprice % 1000) / 1000 AS confidence, (o_totalprice % 777) / 1000 AS true_probability FROM orders),
cells AS (SELECT true_class, pred_class, count(*) AS n FROM classed GROUP BY ALL),
classes AS (SELECT true_class AS c FROM cells UNION SELECT pred_class FROM cells),
per_class AS (
  SELECT c, (SELECT coalesce(sum(n), 0) FROM cells WHERE true_class = c AND pred_class = c) AS tp,
    (SELECT coalesce(sum(n), 0) FROM cells WHERE true_class = c) AS support, (SELECT coalesce(sum(n), 0) FROM cells WHERE pred_class = c) AS predicted FROM classes),
f1s AS (SELECT *, CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END AS f1,
  CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per_class)
"""
CLASSES = ["F", "O", "P", "X", "unused"]


def classed(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("true_class"),
        F.when(price < 120000, "F").when(price < 350000, "O").otherwise("X").alias("pred_class"),
        ((price % 1000) / 1000).alias("confidence"),
        ((price % 777) / 1000).alias("true_probability"),
    )


def confusion(spark, folder):
    return M.confusion_counts(classed(spark, folder), "true_class", "pred_class")


@query("macro_f1", with_sql(CLASS_SQL) + f"SELECT sum(support)::bigint AS n, {r('avg(f1)')} AS f1_macro FROM f1s")
def macro_f1(spark, folder):
    return rounded(M.macro_f1(classed(spark, folder), "true_class", "pred_class"))


@query(
    "majority_f1",
    f"""WITH counts AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1), top AS (SELECT c, n FROM counts ORDER BY n DESC, c LIMIT 1)
SELECT (SELECT sum(n) FROM counts)::bigint AS n, {r('(SELECT 2.0 * n / (n + (SELECT sum(n) FROM counts)) FROM top) / (SELECT count(*) FROM counts)')} AS f1_macro""",
)
def majority_f1(spark, folder):
    return rounded(M.majority_f1(table(spark, folder, "orders"), "o_orderpriority"))


@query(
    "class_report",
    with_sql(CLASS_SQL)
    + f"""SELECT i::int AS class_index, l.c AS class, coalesce(round_even(p::double, 6), 0) AS precision, coalesce(round_even(rc::double, 6), 0) AS recall, coalesce(round_even(f1::double, 6), 0) AS f1,
  coalesce(support, 0)::bigint AS support, coalesce(predicted, 0)::bigint AS predicted, """
    + ", ".join(
        f"""(SELECT coalesce(sum(n), 0) FROM cells WHERE true_class = l.c AND pred_class = '{c}')::bigint AS "pred_{c}" """ for c in CLASSES
    )
    + "FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X'), (4, 'unused')) l(i, c) LEFT JOIN f1s ON f1s.c = l.c",
)
def class_report(spark, folder):
    return M.class_report(confusion(spark, folder), CLASSES)


@query(
    "class_summary",
    with_sql(CLASS_SQL)
    + f"""SELECT sum(support)::bigint AS n, {r('sum(tp) / sum(support)')} AS accuracy, {r('avg(f1) FILTER (WHERE support > 0)')} AS macro_f1, {r('sum(f1) / 5')} AS macro_f1_all_classes FROM f1s""",
)
def class_summary(spark, folder):
    return rounded(M.class_summary(confusion(spark, folder), CLASSES))


@query(
    "top_errors",
    with_sql(CLASS_SQL)
    + f"""SELECT o_orderkey, true_class, pred_class, {r('confidence')} AS confidence, {r('true_probability')} AS true_probability, {r('confidence - true_probability')} AS margin
FROM classed WHERE true_class <> pred_class ORDER BY round(confidence, 6) DESC, round(confidence - true_probability, 6) DESC, o_orderkey LIMIT 25""",
)
def top_errors(spark, folder):
    return rounded(W.top_errors(classed(spark, folder), 25, ["o_orderkey"]))


# Masked evaluation over strains with made predictions.
MASKED_SQL = """
masked AS (
  SELECT bacdive_id, coalesce(optimal_temperature_c, 0) AS lt, (optimal_temperature_c IS NOT NULL)::int AS mt, (bacdive_id % 40)::double AS pt,
    coalesce(optimal_ph, 0) AS lp, (optimal_ph IS NOT NULL)::int AS mp, 7.0 AS pp, coalesce(salt_tolerance_pct, 0) AS ls, (salt_tolerance_pct IS NOT NULL)::int AS ms, (bacdive_id % 9)::double AS ps,
    CASE oxygen_requirement WHEN 'anaerobe' THEN 1 ELSE 0 END AS lo, CASE WHEN oxygen_requirement IN ('aerobe', 'anaerobe') THEN 1 ELSE 0 END AS mo,
    (bacdive_id % 4)::int AS po, [(bacdive_id % 5) / 2.0, (bacdive_id % 7) / 3.0, 0.5, -1.0] AS z FROM phenotypes)
"""


def masked(spark, folder):
    k = F.col("bacdive_id")
    return labels_with_mask(phenotypes(spark, folder)).withColumns(
        {
            "pred_optimal_temperature_c": (k % 40).cast("double"),
            "pred_optimal_ph": F.lit(7.0),
            "pred_salt_tolerance_pct": (k % 9).cast("double"),
            "pred_oxygen_requirement": (k % 4).cast("int"),
            "logits": F.array((k % 5) / 2, (k % 7) / 3, F.lit(0.5), F.lit(-1.0)),
        }
    )


ENTROPY = "(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[lo + 1]) * [1.0, 3.0, 1.0, 1.0][lo + 1]"


@query(
    "masked_loss",
    PHENOTYPES.rstrip() + ", " + MASKED_SQL
    + f""", losses AS (SELECT sum(pow(pt - lt, 2) * mt) / greatest(sum(mt), 1) AS t, sum(pow(pp - lp, 2) * mp) / greatest(sum(mp), 1) AS p,
  sum(pow(ps - ls, 2) * ms) / greatest(sum(ms), 1) AS s, sum({ENTROPY} * mo) / greatest(sum(mo), 1) AS o FROM masked)
SELECT {r('t')} AS loss_optimal_temperature_c, {r('p')} AS loss_optimal_ph, {r('s')} AS loss_salt_tolerance_pct, {r('o')} AS loss_oxygen, {r('0.5 * t + p + s + o')} AS loss FROM losses""",
)
def masked_loss(spark, folder):
    return rounded(
        M.masked_loss(
            masked(spark, folder), target_weights={"optimal_temperature_c": 0.5}, class_weights=[1.0, 3.0, 1.0, 1.0]
        )
    )


@query(
    "masked_validation",
    PHENOTYPES.rstrip() + ", " + MASKED_SQL
    + f""", o AS (SELECT lo, po FROM masked WHERE mo = 1), cls AS (SELECT lo AS c FROM o UNION SELECT po FROM o),
f AS (SELECT c, 2.0 * (SELECT count(*) FROM o WHERE lo = c AND po = c) / ((SELECT count(*) FROM o WHERE lo = c) + (SELECT count(*) FROM o WHERE po = c)) AS f1 FROM cls)
SELECT 'optimal_temperature_c' AS target, 'mae' AS metric, {r('avg(abs(pt - lt)) FILTER (WHERE mt = 1)')} AS value, sum(mt)::bigint AS n FROM masked
UNION ALL SELECT 'optimal_ph', 'mae', {r('avg(abs(pp - lp)) FILTER (WHERE mp = 1)')}, sum(mp)::bigint FROM masked
UNION ALL SELECT 'salt_tolerance_pct', 'mae', {r('avg(abs(ps - ls)) FILTER (WHERE ms = 1)')}, sum(ms)::bigint FROM masked
UNION ALL SELECT 'oxygen_requirement', 'f1_macro', {r('(SELECT avg(f1) FROM f)')}, (SELECT count(*) FROM o)""",
)
def masked_validation(spark, folder):
    return rounded(M.masked_validation(masked(spark, folder)))


# Horner form of the published fit of the normal tail, in t.
ERFC_SQL = functools.reduce(
    lambda inner, c: f"({inner}) * t + {c}",
    [-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223],
    "0.17087277",
)


# --- exploration ------------------------------------------------------------

NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_partkey"]
RANKED_SQL = ", ".join(
    f"""{x}_r AS (SELECT '{x}' AS feature, {x}::double AS x, l_extendedprice AS y,
  rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM source{' WHERE l_tax > 0' if x == 'l_tax' else ''})"""
    for x in NUMBERS
)


@query(
    "spearman",
    "WITH source AS (SELECT * FROM lineitem WHERE l_linenumber <> 3), "
    + RANKED_SQL
    + ", rho AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM ("
    + " UNION ALL ".join(f"SELECT * FROM {x}_r" for x in NUMBERS)
    + ") GROUP BY feature), tail AS (SELECT *, abs(rho) * sqrt(n - 1) / sqrt(2) AS z, 1 / (1 + abs(rho) * sqrt(n - 1) / sqrt(2) / 2) AS t FROM rho)"
    + f" SELECT feature, n, {r('rho', 5)} AS spearman_rho, {r(f'least(t * exp(-z * z + {ERFC_SQL}), 1)', 5)} AS p_value FROM tail",
)
def spearman(spark, folder):
    source = lines(spark, folder, *NUMBERS, "l_linenumber", "l_extendedprice").select(
        "l_quantity", "l_discount", "l_partkey",
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice"),
    )
    return rounded(M.spearman(source, NUMBERS, "l_extendedprice"), 5)


@query(
    "class_separation",
    "WITH long AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS feature, l_returnflag AS class, {x}::double AS x FROM lineitem" for x in NUMBERS)
    + f"""), means AS (SELECT feature, class, avg(x) AS mean FROM long GROUP BY ALL),
scored AS (SELECT feature, var_samp(mean) / any_value(within) AS score FROM means JOIN (SELECT feature, var_samp(x) AS within FROM long GROUP BY 1) USING (feature) GROUP BY feature),
best AS (SELECT * FROM scored ORDER BY score DESC, feature LIMIT 3)
SELECT feature, {r('score', 9)} AS score, class, {r('mean', 5)} AS mean FROM best JOIN means USING (feature)""",
)
def class_separation(spark, folder):
    found = M.class_separation(lines(spark, folder, *NUMBERS, "l_returnflag"), NUMBERS, "l_returnflag", top_n=3)
    return found.select("feature", F.round("score", 9).alias("score"), "class", F.round("mean", 5).alias("mean"))


@query(
    "class_separation_embeddings",
    f"""WITH long AS (SELECT label AS class, unnest(range(0, 64)) AS i, unnest(embedding)::double AS x FROM embeddings),
means AS (SELECT i, class, avg(x) AS mean FROM long GROUP BY ALL),
scored AS (SELECT i, var_samp(mean) / any_value(within) AS score FROM means JOIN (SELECT i, var_samp(x) AS within FROM long GROUP BY 1) USING (i) GROUP BY i),
best AS (SELECT * FROM scored ORDER BY score DESC LIMIT 5)
SELECT 'emb_' || i AS feature, {r('score')} AS score, class, {r('mean')} AS mean FROM best JOIN means USING (i)""",
)
def class_separation_embeddings(spark, folder):
    from cultiva.functions.vectors import flatten

    wide = table(spark, folder, "embeddings").select("label", *flatten(F.col("embedding"), 64, "emb_"))
    return rounded(M.class_separation(wide, [f"emb_{i}" for i in range(64)], "label"))


# --- comparison -------------------------------------------------------------

RUNS_SQL = """
folds AS (
  SELECT l_returnflag || l_linestatus AS target, CASE l_linestatus WHEN 'O' THEN 'classification' ELSE 'regression' END AS task, l_linenumber AS fold,
         avg(l_quantity) / 30 AS a, avg(l_tax) * 20 AS b FROM lineitem GROUP BY ALL),
runs AS (SELECT target, task, avg(a) AS a, avg(b) AS b FROM folds GROUP BY ALL)
"""
COMPARED = f"""SELECT target, task, {r('a')} AS value_a, {r('b')} AS value_b, {r('b - a')} AS delta,
  {r("100 * (b - a) / CASE task WHEN 'classification' THEN greatest(a, 0.001) ELSE a END", 4)} AS delta_pct,
  CASE WHEN abs(b - a) < 1e-9 THEN 'tie' WHEN (task = 'classification' AND b > a) OR (task = 'regression' AND b < a) THEN 'better' ELSE 'worse' END AS verdict FROM runs"""


def fold_runs(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("target"),
            F.when(F.col("l_linestatus") == "O", "classification").otherwise("regression").alias("task"),
            F.col("l_linenumber").alias("fold"),
        )
        .agg((F.avg("l_quantity") / 30).alias("a"), (F.avg("l_tax") * 20).alias("b"))
    )


def shown(compared):
    return compared.select(
        "target", "task", *[F.round(c, 6).alias(c) for c in ("value_a", "value_b", "delta")],
        F.round("delta_pct", 4).alias("delta_pct"), "verdict",
    )


@query("ab_lift", with_sql(RUNS_SQL) + COMPARED)
def ab_lift(spark, folder):
    runs = fold_runs(spark, folder)
    return shown(
        M.ab_lift(
            runs.select("target", "task", "fold", F.col("a").alias("value")),
            runs.select("target", "task", "fold", F.col("b").alias("value")),
        )
    )


@query("compare_runs", with_sql(RUNS_SQL) + COMPARED)
def compare_runs(spark, folder):
    means = A.fold_means(fold_runs(spark, folder), ["target", "task"], ["a", "b"])
    return shown(
        M.compare_runs(
            means.select("target", "task", F.col("mean_a").alias("value")),
            means.select("target", "task", F.col("mean_b").alias("value")),
        )
    )


@query(
    "improvement_over_baseline",
    with_sql(RUNS_SQL)
    + f"""SELECT target, {r("100 * CASE task WHEN 'classification' THEN (a - b) / greatest(b, 0.01) ELSE (b - a) / b END", 4)} AS improvement_pct,
  {r("100 * CASE task WHEN 'classification' THEN a - b ELSE b - a END / greatest(b, 0.001)", 4)} AS headline_pct,
  CASE WHEN b < a - 0.001 THEN 'HELPS' WHEN b > a + 0.001 THEN 'HURTS' ELSE 'WASH' END AS verdict FROM runs""",
)
def improvement_over_baseline(spark, folder):
    means = A.fold_means(fold_runs(spark, folder), ["target", "task"], ["a", "b"])
    a, b, task = F.col("mean_a"), F.col("mean_b"), F.col("task")
    return rounded(
        means.select(
            "target",
            M.improvement_pct(a, b, task).alias("improvement_pct"),
            M.improvement_pct(a, b, task, headline=True).alias("headline_pct"),
            M.weak_label_verdict(a, b).alias("verdict"),
        ),
        4,
    )


@query(
    "rank_importance",
    IMPORTANCE_SQL.replace("SELECT l_extendedprice AS importance", "SELECT l_returnflag AS target, l_extendedprice AS importance")
    + """, means AS (SELECT target, feature, round(avg(importance), 4) AS importance FROM named GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY importance DESC, feature)::int AS rank FROM means) SELECT * FROM ranked WHERE rank <= 6""",
)
def rank_importance(spark, folder):
    means = importances(spark, folder).groupBy(F.col("l_returnflag").alias("target"), "feature").agg(
        F.round(F.avg("importance"), 4).alias("importance")
    )
    return M.rank_importance(means, 6)


@query(
    "report_baselines",
    PHENOTYPES
    + f"""SELECT 'optimal_ph' AS target, 'regression' AS task, count(*) AS n, {r('avg(abs(optimal_ph - m))')} AS baseline FROM phenotypes, (SELECT avg(optimal_ph) AS m FROM phenotypes) WHERE optimal_ph IS NOT NULL
UNION ALL SELECT 'oxygen_requirement', 'classification', sum(n)::bigint, {r('2.0 * max(n) / (max(n) + sum(n)) / count(*)')} FROM (SELECT oxygen_requirement, count(*) AS n FROM phenotypes WHERE oxygen_requirement IS NOT NULL GROUP BY 1)""",
)
def report_baselines(spark, folder):
    df = phenotypes(spark, folder).select("optimal_ph", "oxygen_requirement")
    return rounded(report.baselines(df))


# --- external benchmark -----------------------------------------------------

EXTERNAL_SQL = """
runs AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'ok' END AS status, o_totalprice / 10000 AS true_t, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (o_custkey % 50)::double END AS pred_t,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 14)::double END AS true_p, 7.0 AS pred_p, NULL::double AS true_s, 1.0 AS pred_s, (o_orderkey % 100) / 10.0 AS elapsed FROM orders)
"""


@query(
    "external_summary",
    with_sql(EXTERNAL_SQL)
    + f"""SELECT count(*) AS n_requested, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status <> 'ok') AS n_failed_or_skipped,
  {r("avg(abs(true_t - pred_t)) FILTER (WHERE status = 'ok')")} AS temperature_mae_c, {r("avg(abs(true_p - pred_p)) FILTER (WHERE status = 'ok')")} AS ph_mae,
  {r("avg(abs(true_s - pred_s)) FILTER (WHERE status = 'ok')")} AS salt_mae_pct, {r("avg(elapsed) FILTER (WHERE status = 'ok')")} AS mean_elapsed_s FROM runs""",
)
def external_summary(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    runs = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"),
        (F.col("o_totalprice") / 10000).alias("true_temperature_c"),
        F.when(c % 3 != 0, (c % 50).cast("double")).alias("external_temperature_c"),
        F.when(k % 4 != 0, (k % 14).cast("double")).alias("true_ph"),
        F.lit(7.0).alias("external_ph"),
        F.lit(None).cast("double").alias("true_salt_pct"),
        F.lit(1.0).alias("external_salt_pct"),
        ((k % 100) / 10).alias("elapsed_s"),
    )
    return rounded(M.external_summary(runs))


@query(
    "interval_coverage",
    PHENOTYPES
    + f"""SELECT 'optimal_temperature_c' AS target, count(*) AS n, {r('avg(coalesce(optimal_temperature_c BETWEEN 10 AND 60, false)::int)')} AS coverage FROM phenotypes
UNION ALL SELECT 'optimal_ph', count(*), {r('avg(coalesce(optimal_ph BETWEEN 4 AND (bacdive_id % 9), false)::int)')} FROM phenotypes""",
)
def interval_coverage(spark, folder):
    df = phenotypes(spark, folder).withColumns(
        {
            "pred_optimal_temperature_c_low_80": F.lit(10.0),
            "pred_optimal_temperature_c_high_80": F.lit(60.0),
            "pred_optimal_ph_low_80": F.lit(4.0),
            "pred_optimal_ph_high_80": (F.col("bacdive_id") % 9).cast("double"),
        }
    )
    return rounded(M.interval_coverage(df, ["optimal_temperature_c", "optimal_ph"]))


MANIFEST_SQL = "manifest AS (SELECT *, (bacdive_id % 5)::int AS fold, (bacdive_id % 3)::int AS n_true_media FROM phenotypes)"


def manifest(spark, folder):
    k = F.col("bacdive_id")
    return phenotypes(spark, folder).withColumns(
        {"fold": (k % 5).cast("int"), "n_true_media": (k % 3).cast("int")}
    )


@query(
    "fold_label_counts",
    PHENOTYPES.rstrip() + ", " + MANIFEST_SQL
    + """ SELECT fold, count(*) AS n, count(optimal_temperature_c) AS temperature, count(optimal_ph) AS ph, count(salt_tolerance_pct) AS salt,
  count(*) FILTER (WHERE oxygen_requirement <> '') AS oxygen, count(*) FILTER (WHERE n_true_media > 0) AS medium FROM manifest GROUP BY fold""",
)
def fold_label_counts(spark, folder):
    return A.fold_label_counts(manifest(spark, folder))


@query(
    "require_labels",
    PHENOTYPES.rstrip() + ", " + MANIFEST_SQL
    + " SELECT bacdive_id FROM manifest WHERE optimal_temperature_c IS NOT NULL AND oxygen_requirement <> '' AND n_true_media > 0",
)
def require_labels_query(spark, folder):
    return require_labels(manifest(spark, folder), ["temperature", "oxygen", "medium"]).select("bacdive_id")
