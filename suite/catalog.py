"""The scored catalog: customers are genomes with predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.operators import catalog as C
from cultiva.operators import filters as P
from cultiva.operators import joins as J
from cultiva.operators import ranking as W
from suite.base import query, r, rounded, table, with_sql
from suite.media import MEDIA_SQL, SCORES_SQL, TOP3, LINKS_SQL, media_names, scores

BASE_SQL = """
base AS (
  SELECT 'S' || c_custkey AS genome_accession, 'd__B;p__' || n_name AS gtdb_taxonomy, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'uncultured ' || c_name ELSE c_name END AS ncbi_organism_name,
    90 + (c_custkey % 100) / 7.0::double AS checkm_completeness, c_acctbal / 101 AS pred_optimal_temperature_c, 4 + (c_custkey % 60) / 13.0::double AS pred_optimal_ph,
    CASE c_custkey % 4 WHEN 0 THEN 'aerobe' WHEN 1 THEN 'Anaerobe' WHEN 2 THEN 'facultative anaerobe' END AS pred_oxygen_requirement,
    (c_custkey % 99) / 99.0::double AS pred_oxygen_requirement_confidence, (c_custkey % 50) / 7.0::double AS pred_salt_tolerance_pct
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
newer AS (
  SELECT 'S' || o_custkey AS genome_accession, max(o_totalprice) / 7001 AS pred_optimal_temperature_c, 'microaerophile' AS pred_oxygen_requirement, 'hybrid' AS pred_oxygen_requirement_source, count(*) AS pred_extra
  FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey),
overlaid AS (
  SELECT b.* EXCLUDE (pred_optimal_temperature_c, pred_oxygen_requirement), coalesce(n.pred_optimal_temperature_c, b.pred_optimal_temperature_c) AS pred_optimal_temperature_c,
    coalesce(n.pred_oxygen_requirement, b.pred_oxygen_requirement) AS pred_oxygen_requirement, coalesce(n.pred_oxygen_requirement_source, 'tabular') AS pred_oxygen_requirement_source, n.pred_extra
  FROM base b LEFT JOIN newer n USING (genome_accession))
"""


def base(spark, folder):
    k = F.col("c_custkey")
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.concat(F.lit("S"), k).alias("genome_accession"),
        F.concat(F.lit("d__B;p__"), "n_name").alias("gtdb_taxonomy"),
        F.when(k % 5 == 1, F.concat(F.lit("uncultured "), "c_name")).when(k % 5 != 0, F.col("c_name")).alias("ncbi_organism_name"),
        (90 + (k % 100) / 7).alias("checkm_completeness"),
        (F.col("c_acctbal") / 101).alias("pred_optimal_temperature_c"),
        (4 + (k % 60) / 13).alias("pred_optimal_ph"),
        F.when(k % 4 == 0, "aerobe").when(k % 4 == 1, "Anaerobe").when(k % 4 == 2, "facultative anaerobe").alias("pred_oxygen_requirement"),
        ((k % 99) / 99).alias("pred_oxygen_requirement_confidence"),
        ((k % 50) / 7).alias("pred_salt_tolerance_pct"),
    )


def newer(spark, folder):
    return (
        table(spark, folder, "orders")
        .filter(F.col("o_custkey") % 3 == 0)
        .groupBy(F.concat(F.lit("S"), "o_custkey").alias("genome_accession"))
        .agg(
            (F.max("o_totalprice") / 7001).alias("pred_optimal_temperature_c"),
            F.lit("microaerophile").alias("pred_oxygen_requirement"),
            F.lit("hybrid").alias("pred_oxygen_requirement_source"),
            F.count(F.lit(1)).alias("pred_extra"),
        )
    )


@query(
    "overlay_predictions",
    with_sql(BASE_SQL)
    + f"""SELECT genome_accession, gtdb_taxonomy, ncbi_organism_name, {r('checkm_completeness')} AS checkm_completeness, {r('pred_optimal_temperature_c')} AS pred_optimal_temperature_c,
  {r('pred_optimal_ph')} AS pred_optimal_ph, pred_oxygen_requirement, {r('pred_oxygen_requirement_confidence')} AS pred_oxygen_requirement_confidence,
  {r('pred_salt_tolerance_pct')} AS pred_salt_tolerance_pct, pred_oxygen_requirement_source, pred_extra FROM overlaid""",
)
def overlay_predictions(spark, folder):
    return rounded(J.overlay(base(spark, folder), newer(spark, folder)))


TOP_SQL = f"""
top3 AS (SELECT genome_accession, {TOP3} FROM (SELECT *, row_number() OVER (PARTITION BY genome_accession ORDER BY score DESC, medium_id) AS rank FROM scores)
  LEFT JOIN media_names USING (medium_id) WHERE rank <= 3 GROUP BY genome_accession),
catalog AS (SELECT o.*, t.* EXCLUDE (genome_accession), coalesce(nullif(split_part(gtdb_taxonomy, 'p__', 2), ''), '—') AS phylum,
  coalesce(ncbi_organism_name LIKE 'uncultured%', false) AS truly_uncultured FROM overlaid o LEFT JOIN top3 t USING (genome_accession))
"""
CATALOG = with_sql(LINKS_SQL, SCORES_SQL, MEDIA_SQL, BASE_SQL, TOP_SQL)


def catalog(spark, folder):
    stale = base(spark, folder).withColumn("top1_medium_id", F.lit("old"))
    top = W.top_media_wide(scores(spark, folder), media_names(spark, folder))
    return C.load_catalog(W.attach_top_media(stale, top), newer(spark, folder))


@query(
    "catalog_rows",
    CATALOG
    + """SELECT genome_accession AS accession, coalesce(ncbi_organism_name, genome_accession) AS name, phylum, round_even(checkm_completeness, 1) AS completeness, truly_uncultured,
  round_even(pred_optimal_temperature_c, 1) + 0.0 AS "T_opt", round_even(pred_optimal_ph, 2) AS "pH", coalesce(pred_oxygen_requirement, '—') AS "O2", round_even(pred_oxygen_requirement_confidence, 3) AS "O2_conf",
  pred_oxygen_requirement_source AS "O2_source", round_even(pred_salt_tolerance_pct, 2) AS salt, coalesce(top1_medium_id, '—') AS top_medium_id, coalesce(top1_medium_name, '—') AS top_medium_name,
  coalesce(round_even(top1_confidence, 4), 0) AS top_confidence, top2_medium_id, top2_medium_name, round_even(top2_confidence, 4) AS top2_confidence,
  top3_medium_id, top3_medium_name, round_even(top3_confidence, 4) AS top3_confidence FROM catalog""",
)
def catalog_rows(spark, folder):
    return C.catalog_rows(catalog(spark, folder))


PRESETS = {
    "all": "true",
    "thermo": "pred_optimal_temperature_c > 55",
    "psychro": "pred_optimal_temperature_c < 15",
    "anaerobe": "lower(pred_oxygen_requirement) LIKE '%anaerobe%'",
    "halo": "pred_salt_tolerance_pct > 3",
}


@query(
    "catalog_presets",
    CATALOG
    + " UNION ALL ".join(
        f"SELECT '{name}' AS preset, count(*) AS n, {r('max(pred_optimal_temperature_c)')} AS hottest FROM catalog WHERE {test}"
        for name, test in PRESETS.items()
    ),
)
def catalog_presets(spark, folder):
    return rounded(P.preset_counts(catalog(spark, folder), "pred_optimal_temperature_c", "hottest"))


@query(
    "catalog_search",
    with_sql(BASE_SQL)
    + "SELECT genome_accession, ncbi_organism_name FROM base WHERE lower(ncbi_organism_name) LIKE '%red customer#0%' OR lower(genome_accession) LIKE '%red customer#0%'",
)
def catalog_search(spark, folder):
    return P.catalog_search(base(spark, folder), "RED Customer#0").select("genome_accession", "ncbi_organism_name")


@query(
    "catalog_browse",
    CATALOG
    + f"""SELECT genome_accession, top1_medium_id, top1_confidence, {r('pred_salt_tolerance_pct')} AS pred_salt_tolerance_pct FROM catalog WHERE pred_salt_tolerance_pct > 3 AND truly_uncultured
ORDER BY top1_confidence DESC NULLS LAST, genome_accession LIMIT 86""",
)
def catalog_browse(spark, folder):
    page = C.browse(catalog(spark, folder), "halo", uncultured_only=True)
    return rounded(page.select("genome_accession", "top1_medium_id", "top1_confidence", "pred_salt_tolerance_pct"))


@query(
    "catalog_bands",
    with_sql(BASE_SQL)
    + """SELECT CASE WHEN pred_optimal_temperature_c < 15 THEN '<15' WHEN pred_optimal_temperature_c < 30 THEN '15-30' WHEN pred_optimal_temperature_c < 45 THEN '30-45' WHEN pred_optimal_temperature_c < 60 THEN '45-60' ELSE '>=60' END AS temperature_band,
  CASE WHEN pred_optimal_ph < 6 THEN '<6' WHEN pred_optimal_ph < 7.5 THEN '6-7.5' ELSE '>=7.5' END AS ph_band,
  CASE WHEN pred_salt_tolerance_pct < 1 THEN '<1' WHEN pred_salt_tolerance_pct < 5 THEN '1-5' ELSE '>=5' END AS salt_band, count(*) AS n FROM base GROUP BY ALL""",
)
def catalog_bands(spark, folder):
    return C.with_bands(base(spark, folder)).groupBy("temperature_band", "ph_band", "salt_band").agg(
        F.count(F.lit(1)).alias("n")
    )


HYBRID_SQL = """
model AS (SELECT 'S' || o_custkey AS genome_accession, 'aerobe' AS label, max(o_totalprice % 1) AS conf FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey)
"""


@query(
    "hybrid_predictions",
    with_sql(BASE_SQL, HYBRID_SQL)
    + f"""SELECT genome_accession, {r('pred_optimal_ph')} AS pred_optimal_ph, {r('pred_optimal_ph - 1')} AS pred_optimal_ph_low_80, coalesce(label, pred_oxygen_requirement) AS pred_oxygen_requirement,
  {r('CASE WHEN label IS NOT NULL THEN conf WHEN pred_oxygen_requirement IS NOT NULL THEN pred_oxygen_requirement_confidence END')} AS pred_oxygen_requirement_confidence,
  CASE WHEN label IS NOT NULL THEN 'model' WHEN pred_oxygen_requirement IS NOT NULL THEN 'tabular' END AS pred_oxygen_requirement_source FROM base LEFT JOIN model USING (genome_accession)""",
)
def hybrid_predictions(spark, folder):
    rows = base(spark, folder)
    tabular = rows.select("genome_accession", "pred_optimal_ph", (F.col("pred_optimal_ph") - 1).alias("pred_optimal_ph_low_80"))
    oxygen = (
        table(spark, folder, "orders")
        .filter(F.col("o_custkey") % 2 == 0)
        .groupBy(F.concat(F.lit("S"), "o_custkey").alias("genome_accession"))
        .agg(
            F.lit("aerobe").alias("pred_oxygen_requirement"),
            F.max(F.col("o_totalprice") % 1).alias("pred_oxygen_requirement_confidence"),
            F.lit("model").alias("pred_oxygen_requirement_source"),
        )
    )
    return rounded(J.hybrid_predictions(rows, tabular, oxygen))


@query(
    "join_marker_sequences",
    """SELECT c_custkey, s.n_sequences FROM customer LEFT JOIN (
  SELECT user_id, min_by(length(event_type), event_id)::int AS n_sequences FROM events GROUP BY user_id) s ON user_id = c_custkey""",
)
def join_marker_sequences(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_custkey").alias("genome_accession"))
    sequences = table(spark, folder, "events").select(
        F.col("user_id").alias("genome_accession"),
        F.create_map(F.lit("oxygen"), F.array("event_type")).alias("by_category"),
        F.create_map(F.lit("oxygen"), F.length("event_type")).alias("category_counts"),
        "event_id",
    )
    joined = J.join_sequences(rows, sequences, ["event_id"], matched_only=False)
    return joined.select("c_custkey", F.col("category_counts")["oxygen"].alias("n_sequences"))
