"""The whole chain: documents, labels, features, folds and every section of the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.plans import study as S
from cultiva.plans.boosting import Trees
from suite.base import lines, query, r, rounded, spread, table
from suite.documents import KEYS_SQL, PH, SALT, TEMPERATURE, strain_docs
from suite.models import folds_sql

TREES = Trees(iterations=10, depth=4, step=0.3, bins=32)
MEASURED = ("n_lines", "mean_quantity", "gc_content")
REGRESSION = values.REGRESSION_TARGETS

# The table the chain trains on: labels of the documents, pH also from order dates.
DATASET_SQL = f"""
{KEYS_SQL.strip()},
measured AS (
  SELECT l_orderkey AS k, count(*)::double AS n_lines, avg(l_quantity)::double AS mean_quantity, (l_orderkey % 40) / 40.0::double AS gc_content
  FROM lineitem GROUP BY l_orderkey),
weak AS (SELECT o_orderkey AS k, (o_custkey % 9)::double AS weak_ph FROM orders WHERE o_orderkey % 7 = 0),
dataset AS (
  SELECT k AS bacdive_id, CASE k % 3 WHEN 0 THEN 'L' || (k % 10) WHEN 1 THEN 'F' || (k % 7) END AS family,
    CASE k % 3 WHEN 0 THEN 'L' || (k % 10) WHEN 1 THEN 'F' || (k % 7) ELSE 'G' || (k % 7) END AS "group",
    ({TEMPERATURE})::double AS optimal_temperature_c, coalesce(({PH})::double, weak_ph) AS optimal_ph,
    CASE k % 4 WHEN 0 THEN 'aerobe' WHEN 1 THEN 'anaerobe' END AS oxygen_requirement, ({SALT})::double AS salt_tolerance_pct,
    n_lines, mean_quantity, gc_content,
    CASE k % 3 WHEN 0 THEN ['1:Env', '1:Host', '2:Human'] WHEN 1 THEN ['1:E' || (k % 4)] ELSE [] END AS tags
  FROM keys JOIN measured USING (k) LEFT JOIN weak USING (k)
  WHERE k % 5 < 3 AND (k % 6 < 4 OR k % 5 < 2 OR weak_ph IS NOT NULL OR k % 4 < 2))
"""


def documents_study(spark, folder) -> S.Study:
    accession = F.expr(
        "CASE bacdive_id % 5 WHEN 0 THEN concat('N', bacdive_id) WHEN 1 THEN concat('A', bacdive_id)"
        " WHEN 2 THEN concat('I', bacdive_id) END"
    )
    features = (
        lines(spark, folder, "l_orderkey", "l_quantity")
        .groupBy(F.col("l_orderkey").alias("bacdive_id"))
        .agg(F.count(F.lit(1)).cast("double").alias("n_lines"), F.avg("l_quantity").cast("double").alias("mean_quantity"))
        .withColumns({"gc_content": (F.col("bacdive_id") % 40) / 40, "genome_accession": accession})
    )
    weak = table(spark, folder, "orders").filter("o_orderkey % 7 = 0").select(
        F.col("o_orderkey").alias("bacdive_id"), (F.col("o_custkey") % 9).cast("double").alias("md_ph_median")
    )
    return S.prepare(strain_docs(spark, folder), features, spread(weak, "bacdive_id"))


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Sections of several targets below each other."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("target"), "*") for t, df in parts.items()])


def per_target_sql(select: str, targets=REGRESSION) -> str:
    return " UNION ALL ".join(select.replace("{t}", t) for t in targets)


@query(
    "study_corpus",
    f"""WITH {DATASET_SQL.strip()}
SELECT count(*) AS n_strains, ({len(MEASURED)} + (SELECT count(*) FROM (SELECT tag FROM (SELECT unnest(tags) AS tag FROM dataset) GROUP BY tag HAVING count(*) >= 10)))::int AS n_features,
  count(optimal_temperature_c) AS n_optimal_temperature_c, count(optimal_ph) AS n_optimal_ph, count(oxygen_requirement) AS n_oxygen_requirement,
  count(salt_tolerance_pct) AS n_salt_tolerance_pct FROM dataset""",
)
def study_corpus(spark, folder):
    return documents_study(spark, folder).sections(["corpus"])["corpus"]


@query(
    "study_distributions",
    f"WITH {DATASET_SQL.strip()} "
    + per_target_sql(
        f"""SELECT '{{t}}' AS target, count({{t}}) AS n, {r('avg({t})', 4)} AS mean, {r('stddev_samp({t})', 4)} AS std, count(*) FILTER ({{t}} >= 50) AS n_ge_50,
  count(*) FILTER ({{t}} <= 15) AS n_le_15, {r('quantile_cont({t}, 0.1)', 4)} AS p10, {r('median({t})', 4)} AS median, {r('quantile_cont({t}, 0.9)', 4)} AS p90 FROM dataset"""
    ),
)
def study_distributions(spark, folder):
    names = {t: f"distribution_{t}" for t in REGRESSION}
    sections = documents_study(spark, folder).sections(names.values())
    return rounded(stacked({t: sections[name] for t, name in names.items()}), 4)


@query(
    "study_correlations",
    f"WITH {DATASET_SQL.strip()}, pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{f}' AS feature, {f} AS x, {t} AS y FROM dataset WHERE {t} IS NOT NULL"
        for t in REGRESSION for f in MEASURED
    )
    + f"""), ranked AS (SELECT target, feature,
  rank() OVER (PARTITION BY target, feature ORDER BY x) + (count(*) OVER (PARTITION BY target, feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY target, feature ORDER BY y) + (count(*) OVER (PARTITION BY target, feature, y) - 1) / 2.0 AS ry FROM pairs)
SELECT target, feature, count(*) AS n, {r('corr(rx, ry)', 5)} AS spearman_rho FROM ranked GROUP BY ALL""",
)
def study_correlations(spark, folder):
    """Of the measured features; tag columns share ranks, so their order is not fixed."""
    study = documents_study(spark, folder)
    study.features = list(MEASURED)
    names = {t: f"correlations_{t}" for t in REGRESSION}
    sections = study.sections(names.values())
    found = stacked({t: sections[name] for t, name in names.items()})
    return rounded(found.select("target", "feature", "n", "spearman_rho"), 5)


@query(
    "study_oxygen_classes",
    f"""WITH {DATASET_SQL.strip()}
SELECT oxygen_requirement, count(*) AS n FROM dataset WHERE oxygen_requirement IS NOT NULL GROUP BY 1""",
)
def study_oxygen_classes(spark, folder):
    return documents_study(spark, folder).sections(["oxygen_classes"])["oxygen_classes"]


RESULTS_SQL = f"""WITH RECURSIVE {DATASET_SQL.strip()}, {', '.join(
    folds_sql('in_' + t, f'SELECT * FROM dataset WHERE {t} IS NOT NULL').strip() for t in values.PHENOTYPE_TARGETS)}
""" + " UNION ALL ".join(
    f"""SELECT 'folds' AS section, '{t}' AS target, fold::varchar AS item, count(*) AS n, true AS ok FROM in_{t} GROUP BY fold
UNION ALL SELECT 'summary', '{t}', '{task}', count({t}), true FROM dataset"""
    for t, task in values.PHENOTYPE_TARGETS.items()
) + "".join(
    f"""
UNION ALL SELECT * FROM (SELECT 'family_errors', '{t}', family, count(*) AS n, true FROM dataset WHERE {t} IS NOT NULL
  GROUP BY family ORDER BY n DESC, family NULLS LAST LIMIT 15)"""
    for t in REGRESSION
)


@query("study_results", RESULTS_SQL)
def study_results(spark, folder):
    """Sections of the fitted models: rows of folds, targets and families, fitted numbers as checks."""
    errors = {t: f"family_errors_{t}" for t in REGRESSION}
    sections = S.fit(documents_study(spark, folder), trees=TREES).sections(["folds", "summary", *errors.values()])
    error = (F.col("value") >= 0) & F.col("metric").isin("mae", "f1_macro")
    parts = [
        sections["folds"].select(F.lit("folds").alias("section"), "target", F.col("fold").cast("string").alias("item"), F.col("n_test").alias("n"), error.alias("ok")),
        sections["summary"].select(
            F.lit("summary").alias("section"), "target", F.col("task").alias("item"), "n",
            # The temperature follows a feature, so its model must beat the constant.
            F.when(F.col("target") == "optimal_temperature_c", F.col("improvement_pct") > 0).otherwise(F.col("value").isNotNull()).alias("ok"),
        ),
    ]
    for t, name in errors.items():
        rows = sections[name]
        parts.append(rows.select(F.lit("family_errors").alias("section"), F.lit(t).alias("target"), F.col("family").alias("item"), "n", (F.col("mae") >= 0).alias("ok")))
    return reduce(DataFrame.unionByName, parts)
