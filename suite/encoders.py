"""Tag, place and label encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.functions import scalars as S
from cultiva.operators import encode as N
from suite.base import STRAINS_SQL, query, r, rounded, table, with_sql
from suite.strains import PHENOTYPES, phenotypes

NAME_TAGS = ["red", "small", "blue", "large", "green", "steel", "brass", "copper"]


def tagged(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.concat(
            "p_type", F.lit("|"), F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))
        ).alias("isolation_cat1"),
        F.when(F.col("p_size") > 5, F.concat(F.lit("Size >"), (F.col("p_size") % 4).cast("string"))).alias("isolation_cat2"),
    )


@query(
    "one_hot_tags",
    """WITH tagged AS (SELECT p_partkey, string_split(p_type || '|' || replace(p_name, ' ', '|'), '|') AS t1, CASE WHEN p_size > 5 THEN 'Size >' || (p_size % 4)::varchar END AS t2 FROM part),
long AS (SELECT p_partkey, 'iso_cat1_' AS level, unnest(list_distinct(t1)) AS tag FROM tagged UNION ALL SELECT p_partkey, 'iso_cat2_', t2 FROM tagged WHERE t2 IS NOT NULL),
kept AS (SELECT level, tag, level || replace(replace(lower(tag), ' ', '_'), '>', 'gt') AS col FROM long GROUP BY ALL HAVING count(*) >= 10),
winners AS (SELECT level, min(tag) AS tag, col FROM kept GROUP BY level, col)
SELECT p_partkey, string_agg(col, ',' ORDER BY col) AS hot, (SELECT count(*) FROM winners) AS n_columns FROM long JOIN winners USING (level, tag) GROUP BY p_partkey""",
)
def one_hot_tags(spark, folder):
    wide, columns = N.one_hot_tags(tagged(spark, folder))
    hot = F.concat_ws(",", *[F.when(F.col(c) == 1, F.lit(c)) for c in sorted(columns)])
    return wide.select("p_partkey", hot.alias("hot"), F.lit(len(columns)).cast("bigint").alias("n_columns"))


PLACES_SQL = """
WITH places AS (
  SELECT c_custkey, n_name AS iso_country, r_name AS iso_continent, CASE c_custkey % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'plant' WHEN 2 THEN 'other' END AS iso_host_kingdom
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
top AS (SELECT iso_country FROM places GROUP BY 1 ORDER BY count(*) DESC, iso_country LIMIT 10),
long AS (
  SELECT c_custkey, 'iso_continent_' || replace(lower(iso_continent), ' ', '_') AS col FROM places
  UNION ALL SELECT c_custkey, 'iso_country_' || lower(iso_country) FROM places WHERE iso_country IN (SELECT iso_country FROM top)
  UNION ALL SELECT c_custkey, 'iso_host_kingdom_' || iso_host_kingdom FROM places WHERE iso_host_kingdom IS NOT NULL)
"""


@query(
    "one_hot_places",
    PLACES_SQL + """SELECT c_custkey, string_agg(col, ',' ORDER BY col) AS hot, 20 AS n_columns FROM long GROUP BY 1""",
)
def one_hot_places(spark, folder):
    k = F.col("c_custkey")
    places = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_custkey", F.col("n_name").alias("iso_country"), F.col("r_name").alias("iso_continent"),
            F.when(k % 6 == 0, "human").when(k % 6 == 1, "plant").when(k % 6 == 2, "other").alias("iso_host_kingdom"),
        )
    )
    wide, columns = N.one_hot_places(places, 10)
    hot = F.concat_ws(",", *[F.when(F.col(c) == 1, F.lit(c)) for c in sorted(columns)])
    return wide.select("c_custkey", hot.alias("hot"), F.lit(len(columns)).alias("n_columns"))


@query(
    "encode_labels",
    """WITH classes AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'))
SELECT o_orderkey, i::double AS label FROM orders JOIN classes USING (o_orderpriority) WHERE o_orderstatus <> 'F'""",
)
def encode_labels(spark, folder):
    orders = table(spark, folder, "orders")
    index = N.class_index(orders.filter("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'"), "o_orderpriority")
    test = orders.filter("o_orderstatus <> 'F'")
    return N.encode_labels(test, "o_orderpriority", index).select("o_orderkey", "label")


@query(
    "reindex_columns",
    "SELECT s_acctbal, NULL::double AS absent, s_suppkey FROM supplier",
)
def reindex_columns(spark, folder):
    return N.reindex(table(spark, folder, "supplier"), ["s_acctbal", "absent", "s_suppkey"])


@query(
    "fill_missing_features",
    PHENOTYPES + f"""SELECT bacdive_id, {r('coalesce(optimal_ph, 0)')} AS optimal_ph, {r('coalesce(salt_tolerance_pct, 0)')} AS salt_tolerance_pct,
  coalesce(family, '__unknown__') AS family FROM phenotypes""",
)
def fill_missing_features(spark, folder):
    df = phenotypes(spark, folder).select("bacdive_id", "optimal_ph", "salt_tolerance_pct", "family")
    with_nan = df.withColumn("optimal_ph", F.coalesce("optimal_ph", F.lit(float("nan"))))
    return rounded(N.fill_unknown(N.fill_features(with_nan, ["optimal_ph", "salt_tolerance_pct"]), "family"))


@query(
    "labels_with_mask",
    PHENOTYPES
    + f"""SELECT bacdive_id, {r('coalesce(optimal_temperature_c, 0)')} AS label_optimal_temperature_c, (optimal_temperature_c IS NOT NULL)::int AS mask_optimal_temperature_c,
  {r('coalesce(optimal_ph, 0)')} AS label_optimal_ph, (optimal_ph IS NOT NULL)::int AS mask_optimal_ph,
  {r('coalesce(salt_tolerance_pct, 0)')} AS label_salt_tolerance_pct, (salt_tolerance_pct IS NOT NULL)::int AS mask_salt_tolerance_pct,
  CASE oxygen_requirement WHEN 'anaerobe' THEN 1 ELSE 0 END AS label_oxygen_requirement,
  CASE WHEN oxygen_requirement IN ('aerobe', 'anaerobe') THEN 1 ELSE 0 END AS mask_oxygen_requirement FROM phenotypes""",
)
def labels_with_mask(spark, folder):
    masked = N.labels_with_mask(phenotypes(spark, folder))
    return rounded(masked.select("bacdive_id", *[c for c in masked.columns if c.startswith(("label_", "mask_"))]))


@query(
    "numeric_columns_only",
    "SELECT p_partkey, p_size, p_retailprice FROM part",
)
def numeric_columns_only(spark, folder):
    from cultiva.operators.joins import numeric_only

    return numeric_only(table(spark, folder, "part"), ())


IMPORTANCE_SQL = """
WITH named AS (
  SELECT l_extendedprice AS importance, ['hmm_COX1_aerobic_n', 'hmm_Hsp20_score', 'hmm_Nope_present', 'aa_frac_A', 'codon_ATG', 'tetra_ACGT', 'iso_cat1_x', 'md_ph_median', 'gc_content', 'hmm_odd'][(l_partkey % 10 + 1)::int] AS feature FROM lineitem)
"""
IMPORTANCE_NAMES = [
    "hmm_COX1_aerobic_n", "hmm_Hsp20_score", "hmm_Nope_present", "aa_frac_A", "codon_ATG", "tetra_ACGT",
    "iso_cat1_x", "md_ph_median", "gc_content", "hmm_odd",
]


def importances(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.get(F.array(*[F.lit(n) for n in IMPORTANCE_NAMES]), (F.col("l_partkey") % 10).cast("int")).alias("feature"),
        F.col("l_extendedprice").alias("importance"),
        "l_returnflag",
    )


@query(
    "feature_family_totals",
    IMPORTANCE_SQL
    + """SELECT CASE feature WHEN 'hmm_COX1_aerobic_n' THEN 'hmm:oxygen' WHEN 'hmm_Hsp20_score' THEN 'hmm:temperature' WHEN 'hmm_Nope_present' THEN 'hmm:unknown' WHEN 'aa_frac_A' THEN 'composition'
  WHEN 'codon_ATG' THEN 'codon' WHEN 'tetra_ACGT' THEN 'tetra' WHEN 'iso_cat1_x' THEN 'iso' WHEN 'md_ph_median' THEN 'mediadive' ELSE 'baseline' END AS feature_family, (round(sum(importance), 2) + 0.0) AS importance
FROM named GROUP BY 1""",
)
def feature_family_totals(spark, folder):
    from cultiva.operators.aggregates import category_totals

    return rounded(category_totals(importances(spark, folder), S.feature_family(F.col("feature"))), 2)
