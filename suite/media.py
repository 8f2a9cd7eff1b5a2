"""Media: links, recipes, popularity and top-k benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.operators import aggregates as A
from cultiva.operators import metrics as M
from cultiva.operators import ranking as W
from cultiva.operators.encode import class_weights, label_matrix, label_table
from cultiva.operators.folds import random_fold
from cultiva.operators.joins import attach_media, with_medium_name
from cultiva.plans import recommender as P
from cultiva.session import materialize
from suite.base import (
    LINKS_SQL, MEDIA_SQL, STRAINS_SQL, links, media_names, query, r, rounded, strains, table, with_sql,
)

MIN_LINKS = 10

# Oracle of the label table and of the greedy folds over family groups.
LABELS_SQL = f"""
kept_strains AS (SELECT DISTINCT bacdive_id FROM links WHERE bacdive_id IN (SELECT bacdive_id FROM strains)),
grown AS (SELECT * FROM links WHERE growth = 'yes' AND bacdive_id IN (SELECT bacdive_id FROM kept_strains)),
kept_media AS (SELECT medium_id, count(*) AS n_strains FROM grown GROUP BY medium_id HAVING count(*) >= {MIN_LINKS}),
positives AS (SELECT DISTINCT bacdive_id, medium_id FROM grown WHERE medium_id IN (SELECT medium_id FROM kept_media))
"""
GROUPED_SQL = """
grouped AS (
  SELECT s.*, coalesce(nullif(family, ''), nullif(genus, ''), split_part(species, ' ', 1), '__unknown__') AS "group"
  FROM strains s WHERE bacdive_id IN (SELECT bacdive_id FROM kept_strains)),
sizes AS (
  SELECT "group", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, "group") AS i
  FROM grouped GROUP BY "group"),
greedy(i, f0, f1, f2, f3, f4, fold) AS (
  SELECT 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, -1
  UNION ALL
  SELECT s.i,
         f0 + CASE WHEN least(f0,f1,f2,f3,f4) = f0 THEN n ELSE 0 END,
         f1 + CASE WHEN least(f0,f1,f2,f3,f4) = f1 AND f0 > f1 THEN n ELSE 0 END,
         f2 + CASE WHEN least(f0,f1,f2,f3,f4) = f2 AND least(f0,f1) > f2 THEN n ELSE 0 END,
         f3 + CASE WHEN least(f0,f1,f2,f3,f4) = f3 AND least(f0,f1,f2) > f3 THEN n ELSE 0 END,
         f4 + CASE WHEN least(f0,f1,f2,f3,f4) = f4 AND least(f0,f1,f2,f3) > f4 THEN n ELSE 0 END,
         CASE least(f0,f1,f2,f3,f4) WHEN f0 THEN 0 WHEN f1 THEN 1 WHEN f2 THEN 2 WHEN f3 THEN 3 ELSE 4 END
  FROM greedy g JOIN sizes s ON s.i = g.i + 1),
folded AS (
  SELECT grouped.*, fold FROM grouped JOIN sizes USING ("group") JOIN greedy USING (i))
"""
FOLDED = with_sql("RECURSIVE " + STRAINS_SQL.strip(), LINKS_SQL, LABELS_SQL, GROUPED_SQL)
POPULARITY_SQL = """
fold_n AS (SELECT fold, count(*) AS fold_n FROM folded GROUP BY fold),
popularity AS (
  SELECT fold, medium_id,
         (SELECT count(*) FROM positives p JOIN folded f USING (bacdive_id)
          WHERE p.medium_id = m.medium_id AND f.fold <> fold_n.fold)::double
         / (SELECT count(*) FROM folded f WHERE f.fold <> fold_n.fold) AS score
  FROM fold_n, kept_media m)
"""


def labelled(spark, folder):
    """Folded strains, their positives and the media of the benchmark."""
    return P.prepare(strains(spark, folder), links(spark, folder), MIN_LINKS, 5, "first_word")


def topk_sql(source: str, ks=(1, 3, 5)) -> str:
    """Oracle of the top-k metrics over ``source(bacdive_id, rank)``."""
    per_row = ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS top{k}" for k in ks)
    cells = ", ".join(
        f"{r(f'avg((best <= {k})::int)')} AS hit_at_{k}, {r(f'avg(top{k}::double / n_true)')} AS recall_at_{k}, "
        f"{r(f'avg(top{k}) / {k}')} AS precision_at_{k}"
        for k in ks
    )
    return f"""
SELECT count(*) AS n_eval, {r('avg(n_true)')} AS mean_true_media, {r('avg(1.0 / best)')} AS mrr, {cells}
FROM (SELECT bacdive_id, count(*) AS n_true, min(rank) AS best, {per_row} FROM {source} GROUP BY bacdive_id)"""


@query(
    "popularity_recommender_topk",
    FOLDED.rstrip() + ", " + POPULARITY_SQL.strip()
    + """,
ranks AS (SELECT fold, medium_id, row_number() OVER (PARTITION BY fold ORDER BY score DESC, medium_id) AS rank FROM popularity),
ranked AS (SELECT p.bacdive_id, rank FROM positives p JOIN folded f USING (bacdive_id) JOIN ranks k ON k.fold = f.fold AND k.medium_id = p.medium_id)
"""
    + topk_sql("ranked"),
)
def popularity_recommender_topk(spark, folder):
    folded, positives, _ = labelled(spark, folder)
    return rounded(P.popularity_benchmark(folded, positives))


@query(
    "popularity_scores",
    FOLDED.rstrip() + ", " + POPULARITY_SQL + f"SELECT fold, medium_id, {r('score')} AS score FROM popularity",
)
def popularity_scores(spark, folder):
    folded, positives, _ = labelled(spark, folder)
    return rounded(M.popularity_scores(folded.select("bacdive_id", "fold"), positives))


TAXON_SQL = """
taxon_n AS (
  SELECT s.bacdive_id, s.fold,
    (SELECT count(*) FROM folded t WHERE t.genus = s.genus AND t.fold <> s.fold) AS genus_n,
    (SELECT count(*) FROM folded t WHERE t.family = s.family AND t.fold <> s.fold) AS family_n,
    s.genus, s.family FROM folded s),
used AS (
  SELECT bacdive_id, fold,
    CASE WHEN genus_n >= 3 THEN 'genus' WHEN family_n >= 3 THEN 'family' ELSE 'global' END AS level,
    CASE WHEN genus_n >= 3 THEN genus WHEN family_n >= 3 THEN family ELSE '' END AS taxon FROM taxon_n),
taxa AS (SELECT DISTINCT fold, level, taxon FROM used),
members AS (
  SELECT a.fold, a.level, a.taxon, f.bacdive_id FROM taxa a JOIN folded f ON f.fold <> a.fold
    AND CASE a.level WHEN 'genus' THEN f.genus = a.taxon WHEN 'family' THEN f.family = a.taxon ELSE true END),
member_n AS (SELECT fold, level, taxon, count(*) AS n FROM members GROUP BY ALL),
member_pos AS (SELECT fold, level, taxon, medium_id, count(*) AS n_pos FROM members JOIN positives USING (bacdive_id) GROUP BY ALL),
taxon_scores AS (
  SELECT a.fold, a.level, a.taxon, m.medium_id, coalesce(n_pos, 0)::double / n AS score
  FROM member_n a CROSS JOIN kept_media m
  LEFT JOIN member_pos p ON p.fold = a.fold AND p.level = a.level AND p.taxon = a.taxon AND p.medium_id = m.medium_id)
"""


def random_folds(spark, folder):
    kept, positives, media = label_table(strains(spark, folder), links(spark, folder), MIN_LINKS)
    folded = strains(spark, folder).join(kept, "bacdive_id", "left_semi")
    # genus and family only help when a taxon is spread over folds
    spread = materialize(folded.withColumn("fold", (F.col("bacdive_id") % 5).cast("int")))
    return spread, materialize(positives), media


SPREAD = (
    with_sql(STRAINS_SQL, LINKS_SQL, LABELS_SQL).rstrip()
    + """, folded AS (SELECT s.*, (bacdive_id % 5)::int AS fold FROM strains s WHERE bacdive_id IN (SELECT bacdive_id FROM kept_strains)), """
    + TAXON_SQL.strip()
)


@query(
    "taxonomy_recommender_topk",
    SPREAD
    + """,
ranks AS (SELECT *, row_number() OVER (PARTITION BY fold, level, taxon ORDER BY score DESC, medium_id) AS rank FROM taxon_scores),
ranked AS (SELECT p.bacdive_id, rank FROM positives p JOIN used USING (bacdive_id)
  JOIN ranks k ON k.fold = used.fold AND k.level = used.level AND k.taxon = used.taxon AND k.medium_id = p.medium_id)
"""
    + topk_sql("ranked"),
)
def taxonomy_recommender_topk(spark, folder):
    spread, positives, media = random_folds(spark, folder)
    return rounded(P.taxonomy_benchmark(spread, positives, media))


@query(
    "taxonomy_scores",
    SPREAD + f" SELECT fold, level, taxon, medium_id, {r('score')} AS score FROM taxon_scores",
)
def taxonomy_scores(spark, folder):
    spread, positives, media = random_folds(spark, folder)
    used, scores = M.taxonomy_scores(spread, positives)
    return rounded(M.every_medium(used, scores, media))


@query(
    "popularity_auc_per_medium",
    FOLDED.rstrip() + ", " + POPULARITY_SQL.strip()
    + f""",
scored AS (
  SELECT f.bacdive_id, s.medium_id, s.score, (p.bacdive_id IS NOT NULL)::int AS y
  FROM folded f JOIN popularity s USING (fold)
  LEFT JOIN positives p ON p.bacdive_id = f.bacdive_id AND p.medium_id = s.medium_id),
steps AS (SELECT medium_id, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL),
summed AS (
  SELECT *, sum(pos) OVER (PARTITION BY medium_id ORDER BY score DESC) AS tp,
         sum(neg) OVER (PARTITION BY medium_id ORDER BY score DESC) AS fp FROM steps)
SELECT medium_id, sum(pos)::bigint AS n_pos, sum(neg)::bigint AS n_neg,
       {r('sum(pos * tp / (tp + fp)) / sum(pos)')} AS pr_auc,
       {r('sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg))')} AS roc_auc
FROM summed GROUP BY medium_id HAVING sum(pos) > 0 AND sum(neg) > 0""",
)
def popularity_auc_per_medium(spark, folder):
    folded, positives, _ = labelled(spark, folder)
    return rounded(P.popularity_auc(folded, positives))


@query("group_folds", FOLDED + 'SELECT bacdive_id, "group", fold FROM folded')
def group_folds_query(spark, folder):
    folded, _, _ = labelled(spark, folder)
    return folded.select("bacdive_id", "group", "fold")


@query(
    "random_folds",
    with_sql(STRAINS_SQL) + "SELECT bacdive_id, (('0x' || substr(md5('42|' || bacdive_id), 1, 8))::bigint % 5)::int AS fold FROM strains",
)
def random_folds_query(spark, folder):
    return strains(spark, folder).select(
        "bacdive_id", random_fold(F.col("bacdive_id"), 5, seed=42).alias("fold")
    )


@query(
    "label_table_positives",
    with_sql(STRAINS_SQL, LINKS_SQL, LABELS_SQL) + "SELECT bacdive_id, medium_id FROM positives",
)
def label_table_positives(spark, folder):
    return label_table(strains(spark, folder), links(spark, folder), MIN_LINKS)[1]


DENSE = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "label_matrix_dense",
    with_sql(STRAINS_SQL, LINKS_SQL, LABELS_SQL)
    + "SELECT k.bacdive_id, "
    + ", ".join(
        f"""max(CASE WHEN medium_id = '{m}' THEN 1 ELSE 0 END)::int AS "{m}" """ for m in DENSE
    )
    + "FROM kept_strains k LEFT JOIN positives p USING (bacdive_id) GROUP BY k.bacdive_id",
)
def label_matrix_dense(spark, folder):
    kept, positives, _ = label_table(strains(spark, folder), links(spark, folder), MIN_LINKS)
    dense = label_matrix(kept, positives, DENSE)
    return dense.select("bacdive_id", *[F.col(m).cast("int").alias(m) for m in DENSE])


@query(
    "frequent_media",
    with_sql(LINKS_SQL)
    + "SELECT medium_id, count(*) AS n_strains FROM links WHERE growth = 'yes' GROUP BY medium_id HAVING count(*) >= 100",
)
def frequent_media(spark, folder):
    return A.frequent_media(links(spark, folder), 100)


@query(
    "link_counts",
    with_sql(LINKS_SQL)
    + "SELECT count(*) AS n_links, count(DISTINCT bacdive_id) AS n_strains, count(DISTINCT medium_id) AS n_media FROM links",
)
def link_counts(spark, folder):
    return A.link_counts(links(spark, folder))


@query("link_growth_counts", with_sql(LINKS_SQL) + "SELECT growth, count(*) AS n FROM links GROUP BY growth")
def link_growth_counts(spark, folder):
    return A.growth_counts(links(spark, folder))


@query(
    "link_top_media",
    with_sql(LINKS_SQL)
    + "SELECT medium_id, medium_name, count(*) AS n FROM links GROUP BY ALL ORDER BY n DESC, medium_id, medium_name LIMIT 10",
)
def link_top_media(spark, folder):
    return A.top_values(links(spark, folder), ["medium_id", "medium_name"], 10)


# Recipes: a part is a compound of its brand's medium.
RECIPES_SQL = """
recipes AS (
  SELECT p_brand AS medium_id,
         CASE p_partkey % 9 WHEN 0 THEN 'NaCl' WHEN 1 THEN 'Sodium chloride' WHEN 2 THEN 'NaCl2' ELSE p_name END AS compound,
         CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size::double / 2 END AS amount,
         CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'g' END AS unit,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::double / 4 END AS g_l
  FROM part)
"""


def recipes(spark, folder, medium="p_brand"):
    """Parts as the compounds of the medium that ``medium`` names."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.col(medium).alias("medium_id"),
        F.when(key % 9 == 0, "NaCl").when(key % 9 == 1, "Sodium chloride").when(key % 9 == 2, "NaCl2")
        .otherwise(F.col("p_name")).alias("compound"),
        F.when(key % 4 != 0, F.col("p_size") / 2).alias("amount"),
        F.when(key % 6 != 0, "g").alias("unit"),
        F.when(key % 5 != 0, F.col("p_size") / 4).alias("g_l"),
    )


@query(
    "compound_usage",
    with_sql(RECIPES_SQL)
    + f"SELECT compound, count(DISTINCT medium_id) AS n_media, {r('median(g_l)')} AS median_g_l FROM recipes GROUP BY compound ORDER BY n_media DESC, compound LIMIT 15",
)
def compound_usage(spark, folder):
    return rounded(A.compound_usage(recipes(spark, folder)))


NACL_SQL = """
nacl AS (
  SELECT medium_id, least(coalesce(sum(g_l), 0) / 10, 30.0) AS m_nacl FROM recipes
  WHERE regexp_matches(lower(compound), 'sodium chlor|^nacl$') GROUP BY medium_id)
"""


@query("medium_nacl_pct", with_sql(RECIPES_SQL, NACL_SQL) + f"SELECT medium_id, {r('m_nacl')} AS m_nacl FROM nacl")
def medium_nacl_pct(spark, folder):
    return rounded(A.medium_nacl(recipes(spark, folder)))


METADATA_SQL = """
metadata AS (
  SELECT p_brand AS medium_id,
         CASE WHEN min(p_size) > 1 THEN NULL ELSE (min(p_partkey) / 100)::varchar END AS min_ph,
         CASE WHEN p_brand LIKE '%3' THEN 'unknown' ELSE ((max(p_partkey) % 50) / 10.0)::varchar END AS max_ph
  FROM part GROUP BY p_brand),
ph AS (SELECT medium_id, (try_cast(min_ph AS double) + try_cast(max_ph AS double)) / 2 AS m_ph FROM metadata
       WHERE try_cast(min_ph AS double) + try_cast(max_ph AS double) IS NOT NULL)
"""


def metadata(spark, folder):
    per_brand = table(spark, folder, "part").groupBy(F.col("p_brand").alias("medium_id")).agg(
        F.min("p_size").alias("s"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi")
    )
    return per_brand.select(
        "medium_id",
        F.when(F.col("s") <= 1, (F.col("lo") / 100).cast("string")).alias("min_pH"),
        F.when(F.col("medium_id").endswith("3"), "unknown")
        .otherwise(((F.col("hi") % 50) / 10).cast("string")).alias("max_pH"),
    )


@query("medium_ph_midpoint", with_sql(METADATA_SQL) + f"SELECT medium_id, {r('m_ph')} AS m_ph FROM ph")
def medium_ph_midpoint(spark, folder):
    return rounded(A.medium_ph(metadata(spark, folder)))


ATTACHED_SQL = """
attached AS (
  SELECT l.*, m_ph, coalesce(m_nacl, 0.0) AS m_nacl
  FROM links l LEFT JOIN ph USING (medium_id) LEFT JOIN nacl USING (medium_id))
"""


@query(
    "attach_media_to_links",
    with_sql(LINKS_SQL, RECIPES_SQL, NACL_SQL, METADATA_SQL, ATTACHED_SQL)
    + f"SELECT medium_id, growth, count(*) AS n, {r('min(m_ph)')} AS m_ph, {r('max(m_nacl)')} AS m_nacl FROM attached GROUP BY medium_id, growth",
)
def attach_media_to_links(spark, folder):
    attached = attach_media(
        links(spark, folder), A.medium_ph(metadata(spark, folder)), A.medium_nacl(recipes(spark, folder))
    )
    return rounded(
        attached.groupBy("medium_id", "growth").agg(
            F.count(F.lit(1)).alias("n"), F.min("m_ph").alias("m_ph"), F.max("m_nacl").alias("m_nacl")
        )
    )


@query(
    "strain_medium_features",
    with_sql(LINKS_SQL, RECIPES_SQL, NACL_SQL, METADATA_SQL, ATTACHED_SQL)
    + f"""SELECT bacdive_id, count(*) AS md_n_media, {r('median(m_ph)')} AS md_ph_median,
       {r('max(m_ph) - min(m_ph)')} AS md_ph_range, {r('median(m_nacl)')} AS md_nacl_pct_median,
       {r('max(m_nacl)')} AS md_nacl_pct_max
FROM attached WHERE growth = 'yes' GROUP BY bacdive_id""",
)
def strain_medium_features(spark, folder):
    attached = attach_media(
        links(spark, folder), A.medium_ph(metadata(spark, folder)), A.medium_nacl(recipes(spark, folder))
    )
    return rounded(A.strain_medium_features(attached))


@query(
    "recipe_summary",
    with_sql(RECIPES_SQL)
    + """, texts AS (
  SELECT medium_id, row_number() OVER (PARTITION BY medium_id ORDER BY g_l DESC NULLS LAST, compound, amount::varchar NULLS FIRST, unit NULLS FIRST) AS rank,
         CASE WHEN amount IS NOT NULL AND unit IS NOT NULL THEN compound || ' ' || amount::varchar || unit ELSE compound END AS txt
  FROM recipes)
SELECT medium_id, string_agg(txt, ', ' ORDER BY rank) AS recipe FROM texts WHERE rank <= 5 GROUP BY medium_id""",
)
def recipe_summary(spark, folder):
    return W.recipe_summary(recipes(spark, folder))


# Scores: share of a customer's spending on a brand.
SCORES_SQL = """
scores AS (
  SELECT 'S' || bacdive_id::varchar AS genome_accession, medium_id, max(l_quantity) AS score
  FROM links GROUP BY ALL)
"""


def scores(spark, folder):
    return (
        links(spark, folder)
        .groupBy(F.concat(F.lit("S"), F.col("bacdive_id").cast("string")).alias("genome_accession"), "medium_id")
        .agg(F.max("l_quantity").alias("score"))
    )


TOP3 = ", ".join(
    f"max(medium_id) FILTER (WHERE rank = {i}) AS top{i}_medium_id, "
    f"max(coalesce(name, '(unknown)')) FILTER (WHERE rank = {i}) AS top{i}_medium_name, "
    f"max(score) FILTER (WHERE rank = {i}) AS top{i}_confidence"
    for i in (1, 2, 3)
)


@query(
    "top_media_wide",
    with_sql(LINKS_SQL, SCORES_SQL, MEDIA_SQL)
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY genome_accession ORDER BY score DESC, medium_id) AS rank FROM scores)
SELECT genome_accession, {TOP3} FROM ranked LEFT JOIN media_names USING (medium_id) WHERE rank <= 3 GROUP BY genome_accession""",
)
def top_media_wide(spark, folder):
    return W.top_media_wide(scores(spark, folder), media_names(spark, folder))


@query(
    "rank_media_long",
    with_sql(LINKS_SQL, SCORES_SQL)
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY genome_accession ORDER BY score DESC, medium_id)::int AS rank FROM scores)
SELECT genome_accession, medium_id, score, rank FROM ranked WHERE rank <= 8""",
)
def rank_media_long(spark, folder):
    return W.rank_media(scores(spark, folder), 8)


@query(
    "medium_name_lookup",
    with_sql(LINKS_SQL, MEDIA_SQL)
    + """SELECT l.medium_id, coalesce(name, '(unknown)') AS medium_name, count(*) AS n
FROM links l LEFT JOIN media_names USING (medium_id) GROUP BY ALL""",
)
def medium_name_lookup(spark, folder):
    named = with_medium_name(links(spark, folder).drop("medium_name"), media_names(spark, folder))
    return named.groupBy("medium_id", "medium_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "topk_metrics_from_scores",
    with_sql(LINKS_SQL)
    + """, scored AS (
  SELECT bacdive_id, medium_id, avg(l_extendedprice) AS score, max((growth = 'yes')::int) AS y FROM links GROUP BY ALL),
ranked AS (SELECT * FROM (
  SELECT bacdive_id, y, row_number() OVER (PARTITION BY bacdive_id ORDER BY round(score, 4) DESC, medium_id) AS rank FROM scored) WHERE y = 1)
"""
    + topk_sql("ranked"),
)
def topk_metrics_from_scores(spark, folder):
    scored = links(spark, folder).groupBy("bacdive_id", "medium_id").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("score"),
        F.max((F.col("growth") == "yes").cast("int")).alias("y"),
    )
    return rounded(P.model_benchmark(scored))


AUC_SQL = f"""
steps AS (SELECT medium_id, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL),
summed AS (
  SELECT *, sum(pos) OVER (PARTITION BY medium_id ORDER BY score DESC) AS tp,
         sum(neg) OVER (PARTITION BY medium_id ORDER BY score DESC) AS fp FROM steps),
auc AS (
  SELECT medium_id, sum(pos)::bigint AS n_pos, sum(neg)::bigint AS n_neg,
       sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc,
       sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc
  FROM summed GROUP BY medium_id HAVING sum(pos) > 0 AND sum(neg) > 0)
"""
LINE_SCORES_SQL = """
scored AS (SELECT medium_id, l_extendedprice AS score, (growth = 'yes')::int AS y FROM links)
"""


def line_auc(spark, folder):
    return M.per_medium_auc(
        links(spark, folder).select(
            "medium_id", F.col("l_extendedprice").alias("score"), (F.col("growth") == "yes").cast("int").alias("y")
        )
    )


@query(
    "auc_per_medium",
    with_sql(LINKS_SQL, LINE_SCORES_SQL, AUC_SQL)
    + f"SELECT medium_id, n_pos, n_neg, {r('pr_auc')} AS pr_auc, {r('roc_auc')} AS roc_auc FROM auc",
)
def auc_per_medium(spark, folder):
    return rounded(line_auc(spark, folder))


@query(
    "auc_median_over_media",
    with_sql(LINKS_SQL, LINE_SCORES_SQL, AUC_SQL)
    + f"SELECT {r('median(pr_auc)')} AS median_pr_auc, {r('median(roc_auc)')} AS median_roc_auc FROM auc",
)
def auc_median_over_media(spark, folder):
    return rounded(A.summary_median(line_auc(spark, folder)))


@query(
    "class_weights_per_medium",
    with_sql(LINKS_SQL)
    + f"""SELECT medium_id, count(*) FILTER (WHERE growth = 'yes') AS n_pos, count(*) FILTER (WHERE growth <> 'yes') AS n_neg,
       {r("count(*) FILTER (WHERE growth <> 'yes') / greatest(count(*) FILTER (WHERE growth = 'yes'), 1)::double")} AS weight
FROM links GROUP BY medium_id""",
)
def class_weights_per_medium(spark, folder):
    y = links(spark, folder).select("medium_id", (F.col("growth") == "yes").cast("int").alias("y"))
    return rounded(class_weights(y))


@query(
    "heldout_manifest",
    FOLDED.rstrip() + ", " + MEDIA_SQL
    + """, true_media AS (
  SELECT bacdive_id, string_agg(p.medium_id, '|' ORDER BY p.medium_id) AS ids,
         string_agg(coalesce(name, ''), '|' ORDER BY p.medium_id) AS names, count(*) AS n
  FROM positives p LEFT JOIN media_names USING (medium_id) GROUP BY bacdive_id)
SELECT f.bacdive_id, f.fold, genome_accession, coalesce(species, '') AS species, coalesce(genus, '') AS genus,
       coalesce(family, '') AS family, c_acctbal AS optimal_temperature_c, NULL::double AS optimal_ph,
       NULL::double AS salt_tolerance_pct, '' AS oxygen_requirement,
       coalesce(ids, '') AS true_media_ids, coalesce(names, '') AS true_media_names, coalesce(n, 0)::int AS n_true_media
FROM folded f LEFT JOIN true_media t USING (bacdive_id)""",
)
def heldout_manifest(spark, folder):
    folded, positives, _ = labelled(spark, folder)
    labels = folded.select(
        "bacdive_id", "genome_accession", "species", "genus", "family",
        F.col("c_acctbal").alias("optimal_temperature_c"),
        F.lit(None).cast("double").alias("optimal_ph"),
        F.lit(None).cast("double").alias("salt_tolerance_pct"),
        F.lit(None).cast("string").alias("oxygen_requirement"),
    )
    return P.heldout_manifest(folded, positives, labels, media_names(spark, folder))
