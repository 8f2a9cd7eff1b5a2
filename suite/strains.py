"""Strains: filters, joins, label sources and group summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions import scalars as S
from cultiva.operators import aggregates as A
from cultiva.operators import filters as P
from cultiva.operators import joins as J
from cultiva.operators import ranking as W
from suite.base import (
    GENOMES_SQL, HITS_SQL, STRAINS_SQL, genomes, hits, query, r, rounded, strains, table, with_sql,
)

# Phenotypes: strains with labels and accessions missing by rule.
PHENOTYPES_SQL = """
phenotypes AS (
  SELECT bacdive_id, family, genus, species,
    CASE WHEN bacdive_id % 3 = 0 THEN NULL ELSE genome_accession || CASE WHEN bacdive_id % 2 = 0 THEN '.1' ELSE '' END END AS genome_accession,
    CASE WHEN bacdive_id % 4 = 0 THEN NULL ELSE c_acctbal / 100 END AS optimal_temperature_c,
    CASE WHEN bacdive_id % 2 = 0 THEN NULL ELSE (bacdive_id % 80) / 10.0::double END AS optimal_ph,
    CASE bacdive_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'obligate aerobe' WHEN 2 THEN 'anaerobe' WHEN 3 THEN NULL ELSE 'aerobe' END AS oxygen_requirement,
    CASE WHEN bacdive_id % 5 < 3 THEN NULL ELSE (bacdive_id % 60) / 4.0::double END AS salt_tolerance_pct
  FROM strains)
"""
PHENOTYPES = with_sql(STRAINS_SQL, PHENOTYPES_SQL)
LABELS = ("optimal_temperature_c", "optimal_ph", "oxygen_requirement", "salt_tolerance_pct")


def phenotypes(spark, folder):
    k = F.col("bacdive_id")
    version = F.when(k % 2 == 0, ".1").otherwise("")
    return strains(spark, folder).select(
        "bacdive_id", "family", "genus", "species",
        F.when(k % 3 != 0, F.concat("genome_accession", version)).alias("genome_accession"),
        F.when(k % 4 != 0, F.col("c_acctbal") / 100).alias("optimal_temperature_c"),
        F.when(k % 2 != 0, (k % 80) / 10).alias("optimal_ph"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "obligate aerobe").when(k % 6 == 2, "anaerobe")
        .when(k % 6 != 3, "aerobe").alias("oxygen_requirement"),
        F.when(k % 5 >= 3, (k % 60) / 4).alias("salt_tolerance_pct"),
    )


@query(
    "training_ready_any",
    PHENOTYPES + """SELECT bacdive_id FROM phenotypes WHERE genome_accession IS NOT NULL AND (optimal_temperature_c IS NOT NULL
  OR optimal_ph IS NOT NULL OR oxygen_requirement IS NOT NULL OR salt_tolerance_pct IS NOT NULL)""",
)
def training_ready_any(spark, folder):
    return P.training_ready(phenotypes(spark, folder)).select("bacdive_id")


@query(
    "training_ready_one_label",
    PHENOTYPES + "SELECT bacdive_id FROM phenotypes WHERE genome_accession IS NOT NULL AND optimal_ph IS NOT NULL",
)
def training_ready_one_label(spark, folder):
    return P.training_ready(phenotypes(spark, folder), "optimal_ph").select("bacdive_id")


@query(
    "gap_species",
    PHENOTYPES + """SELECT DISTINCT species FROM phenotypes WHERE genome_accession IS NULL AND species LIKE '% %' AND (optimal_temperature_c IS NOT NULL
  OR optimal_ph IS NOT NULL OR oxygen_requirement IS NOT NULL OR salt_tolerance_pct IS NOT NULL)""",
)
def gap_species(spark, folder):
    return P.gap_species(phenotypes(spark, folder))


@query(
    "quality_filter",
    """SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 7 <> 0 AND s_acctbal >= 90""",
)
def quality_filter(spark, folder):
    k = F.col("s_suppkey")
    meta = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.when(k % 3 == 0, "f").otherwise("t").alias("gtdb_representative"),
        F.when(k % 7 == 0, "none").otherwise(F.col("s_acctbal").cast("string")).alias("checkm_completeness"),
    )
    return P.quality_filter(meta).select("s_suppkey")


@query(
    "label_guard",
    PHENOTYPES + """SELECT target, n FROM (SELECT count(optimal_temperature_c) AS t, count(optimal_ph) AS p, count(salt_tolerance_pct) AS s FROM phenotypes),
LATERAL (VALUES ('optimal_temperature_c', t), ('optimal_ph', p), ('salt_tolerance_pct', s)) v(target, n) WHERE n >= 60""",
)
def label_guard(spark, folder):
    df = phenotypes(spark, folder)
    kept = P.trainable_targets(df, values.REGRESSION_TARGETS, 60)
    return A.coverage(df, kept).select(F.col("field").alias("target"), "n")


@query(
    "leakage_guard",
    """SELECT l_returnflag, count(*) AS n, (round(sum(l_quantity), 2) + 0.0) AS hmm_x_n FROM lineitem GROUP BY l_returnflag""",
)
def leakage_guard(spark, folder):
    # medium-derived columns disappear from the features of a medium-derived label
    wide = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("hmm_x_n"),
        F.avg("l_tax").alias("md_ph_median"), F.max("l_tax").alias("md_n_media"),
    )
    return rounded(wide.select("l_returnflag", *P.drop_leaky(wide.columns[1:], "optimal_ph")), 2)


FEATURES_SQL = """
features AS (
  SELECT o_custkey AS bacdive_id, 'GCA_' || lpad((o_custkey % 997)::varchar, 9, '0') || CASE WHEN o_custkey % 2 = 0 THEN '.1' ELSE '' END AS genome_accession,
         count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders GROUP BY o_custkey)
"""


def features(spark, folder):
    k = F.col("o_custkey")
    accession = F.concat(
        F.lit("GCA_"), F.lpad((k % 997).cast("string"), 9, "0"), F.when(k % 2 == 0, ".1").otherwise("")
    )
    return table(spark, folder, "orders").groupBy(k.alias("bacdive_id"), accession.alias("genome_accession")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price")
    )


@query(
    "join_phenotypes_features",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL, FEATURES_SQL)
    + "SELECT bacdive_id, genome_accession, n_orders, top_price FROM phenotypes JOIN features USING (bacdive_id, genome_accession)",
)
def join_phenotypes_features(spark, folder):
    joined = J.join_features(phenotypes(spark, folder), features(spark, folder))
    return joined.select("bacdive_id", "genome_accession", "n_orders", "top_price")


@query(
    "fuse_features",
    with_sql(STRAINS_SQL, FEATURES_SQL)
    + f"""SELECT s.bacdive_id, n_orders, top_price, md_n, md_max, acc_n
FROM (SELECT bacdive_id, genome_accession FROM strains) s
LEFT JOIN features f USING (bacdive_id)
LEFT JOIN (SELECT user_id AS bacdive_id, count(*) AS md_n, max(value) AS md_max FROM events GROUP BY 1) e USING (bacdive_id)
LEFT JOIN (SELECT 'GCA_' || lpad((l_partkey % 997)::varchar, 9, '0') AS genome_accession, count(*) AS acc_n FROM lineitem GROUP BY 1) l
  ON l.genome_accession = s.genome_accession""",
)
def fuse_features(spark, folder):
    base = strains(spark, folder).select("bacdive_id", "genome_accession")
    per_strain = features(spark, folder).drop("genome_accession").withColumn("note", F.lit("text is dropped"))
    per_user = table(spark, folder, "events").groupBy(F.col("user_id").alias("bacdive_id")).agg(
        F.count(F.lit(1)).alias("md_n"), F.max("value").alias("md_max")
    )
    accession = F.concat(F.lit("GCA_"), F.lpad((F.col("l_partkey") % 997).cast("string"), 9, "0"))
    per_genome = table(spark, folder, "lineitem").groupBy(accession.alias("genome_accession")).agg(
        F.count(F.lit(1)).alias("acc_n")
    )
    fused = J.fuse_features(
        base, [(per_strain, "bacdive_id"), (None, "bacdive_id"), (per_user, "bacdive_id"), (per_genome, "genome_accession")]
    )
    return fused.drop("genome_accession")


@query(
    "unknown_candidates",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL)
    + """SELECT DISTINCT a || '.7' AS genome_accession FROM (SELECT 'GCA_' || lpad((o_orderkey % 1500)::varchar, 9, '0') AS a FROM orders)
WHERE a NOT IN (SELECT replace(genome_accession, '.1', '') FROM phenotypes WHERE genome_accession IS NOT NULL)""",
)
def unknown_candidates(spark, folder):
    number = F.lpad((F.col("o_orderkey") % 1500).cast("string"), 9, "0")
    candidates = table(spark, folder, "orders").select(
        F.concat(F.lit("GCA_"), number, F.lit(".7")).alias("genome_accession")
    )
    return J.not_in(candidates, phenotypes(spark, folder)).distinct()


@query(
    "only_strains_with_orders",
    with_sql(STRAINS_SQL) + "SELECT bacdive_id FROM strains WHERE bacdive_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def only_strains_with_orders(spark, folder):
    finished = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("bacdive_id"))
    return J.only_in(strains(spark, folder), finished, ["bacdive_id"]).select("bacdive_id")


ASSEMBLIES_SQL = """
assemblies AS (
  SELECT 'GCA_' || lpad(l_suppkey::varchar, 9, '0') || '.' || (l_linenumber)::varchar AS assembly_accession
  FROM lineitem WHERE (l_suppkey + l_linenumber) % 3 = 0 GROUP BY ALL)
"""


@query(
    "resolve_versions",
    with_sql(STRAINS_SQL, ASSEMBLIES_SQL)
    + """, wanted AS (SELECT bacdive_id, genome_accession || CASE WHEN bacdive_id % 9 = 0 THEN '.2' ELSE '' END AS genome_accession FROM strains)
SELECT bacdive_id, genome_accession, CASE WHEN genome_accession LIKE '%.2' THEN (SELECT min(assembly_accession) FROM assemblies WHERE assembly_accession = genome_accession)
  ELSE (SELECT min(assembly_accession) FROM assemblies WHERE assembly_accession IN (genome_accession || '.1', genome_accession || '.2', genome_accession || '.3', genome_accession || '.4')) END AS resolved
FROM wanted""",
)
def resolve_versions(spark, folder):
    wanted = strains(spark, folder).select(
        "bacdive_id",
        F.concat("genome_accession", F.when(F.col("bacdive_id") % 9 == 0, ".2").otherwise("")).alias("genome_accession"),
    )
    assemblies = (
        table(spark, folder, "lineitem")
        .filter((F.col("l_suppkey") + F.col("l_linenumber")) % 3 == 0)
        .select(
            F.concat(
                F.lit("GCA_"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit("."), F.col("l_linenumber").cast("string")
            ).alias("assembly_accession")
        )
    )
    return J.resolve_versions(wanted, assemblies)


SPECIES_SQL = """
genbank AS (
  SELECT p_type || ' ' || (p_partkey % 5)::varchar AS species, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'GCF_' || lpad(p_partkey::varchar, 9, '0') END AS accession, p_partkey FROM part),
wanted AS (SELECT DISTINCT c_mktsegment || ' ' || (c_custkey % 5)::varchar AS species FROM customer UNION SELECT DISTINCT p_type || ' ' || (p_partkey % 7)::varchar FROM part),
resolved AS (
  SELECT species, min_by(accession, p_partkey) AS ncbi_accession, CASE WHEN min_by(accession, p_partkey) IS NULL THEN 'miss' ELSE 'hit' END AS status
  FROM wanted LEFT JOIN (SELECT * FROM genbank WHERE accession IS NOT NULL) USING (species) GROUP BY species)
"""


def resolved_species(spark, folder):
    part = table(spark, folder, "part")
    genbank = part.select(
        F.concat("p_type", F.lit(" "), (F.col("p_partkey") % 5).cast("string")).alias("species"),
        F.when(
            F.col("p_partkey") % 10 != 0, F.concat(F.lit("GCF_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
        ).alias("accession"),
        "p_partkey",
    )
    wanted = strains(spark, folder).select("species").union(
        part.select(F.concat("p_type", F.lit(" "), (F.col("p_partkey") % 7).cast("string")))
    )
    return J.resolve_species(wanted, genbank, ["p_partkey"])


@query("resolve_species", with_sql(SPECIES_SQL) + "SELECT species, ncbi_accession, status FROM resolved")
def resolve_species(spark, folder):
    return resolved_species(spark, folder)


@query(
    "backfill_accession",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL, SPECIES_SQL)
    + """, named AS (SELECT bacdive_id, genome_accession, CASE WHEN bacdive_id % 2 = 0 THEN species ELSE 'PROMO ' || (bacdive_id % 9)::varchar END AS species FROM phenotypes)
SELECT bacdive_id, n.species, coalesce(genome_accession, ncbi_accession) AS genome_accession,
  CASE WHEN genome_accession IS NULL AND ncbi_accession IS NOT NULL THEN 'species_resolved' ELSE 'bacdive' END AS genome_source
FROM named n LEFT JOIN (SELECT * FROM resolved WHERE status = 'hit') s ON s.species = n.species""",
)
def backfill_accession(spark, folder):
    k = F.col("bacdive_id")
    named = phenotypes(spark, folder).select(
        "bacdive_id", "genome_accession",
        F.when(k % 2 == 0, F.col("species")).otherwise(F.concat(F.lit("PROMO "), (k % 9).cast("string"))).alias("species"),
    )
    return J.backfill_accession(named, resolved_species(spark, folder))


WEAK_SQL = """
weak AS (
  SELECT o_custkey AS bacdive_id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE max(o_totalprice) / 99991 END AS md_ph_median,
         CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE min(o_totalprice) / 9973 END AS md_nacl_pct_median FROM orders GROUP BY o_custkey),
merged AS (
  SELECT bacdive_id, optimal_temperature_c, CASE WHEN optimal_temperature_c IS NOT NULL THEN 'bacdive' ELSE 'unknown' END AS optimal_temperature_c_source,
    coalesce(optimal_ph, md_ph_median) AS optimal_ph,
    CASE WHEN optimal_ph IS NOT NULL THEN 'bacdive' WHEN md_ph_median IS NOT NULL THEN 'mediadive_weak' ELSE 'unknown' END AS optimal_ph_source,
    nullif(oxygen_requirement, '') AS oxygen_requirement,
    CASE WHEN nullif(oxygen_requirement, '') IS NOT NULL THEN 'bacdive' ELSE 'unknown' END AS oxygen_requirement_source,
    coalesce(salt_tolerance_pct, md_nacl_pct_median) AS salt_tolerance_pct,
    CASE WHEN salt_tolerance_pct IS NOT NULL THEN 'bacdive' WHEN md_nacl_pct_median IS NOT NULL THEN 'mediadive_weak' ELSE 'unknown' END AS salt_tolerance_pct_source
  FROM phenotypes LEFT JOIN weak USING (bacdive_id))
"""


def weak(spark, folder):
    k = F.col("bacdive_id")
    per_strain = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("bacdive_id")).agg(
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo")
    )
    return per_strain.select(
        "bacdive_id",
        F.when(k % 7 != 0, F.col("hi") / 99991).alias("md_ph_median"),
        F.when(k % 3 != 0, F.col("lo") / 9973).alias("md_nacl_pct_median"),
    )


def merged_labels(spark, folder):
    df = phenotypes(spark, folder).select("bacdive_id", *LABELS)
    return J.merge_label_sources(df, weak(spark, folder))


@query(
    "merge_label_sources",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL, WEAK_SQL)
    + f"""SELECT * REPLACE ({r('optimal_temperature_c')} AS optimal_temperature_c, {r('optimal_ph')} AS optimal_ph, {r('salt_tolerance_pct')} AS salt_tolerance_pct) FROM merged""",
)
def merge_label_sources(spark, folder):
    return rounded(merged_labels(spark, folder))


@query(
    "backfill_ph",
    with_sql(STRAINS_SQL, PHENOTYPES_SQL, WEAK_SQL)
    + f"""SELECT p.bacdive_id, {r("coalesce(p.optimal_ph, CASE WHEN m.optimal_ph_source = 'mediadive_weak' THEN m.optimal_ph END)")} AS optimal_ph,
  {r('p.salt_tolerance_pct')} AS salt_tolerance_pct FROM phenotypes p JOIN merged m USING (bacdive_id)""",
)
def backfill_ph(spark, folder):
    training = phenotypes(spark, folder).select("bacdive_id", "optimal_ph", "salt_tolerance_pct")
    return rounded(J.backfill_ph(training, merged_labels(spark, folder)))


@query(
    "label_coverage",
    PHENOTYPES
    + f"""SELECT field, n, {r('100.0 * n / total')} AS pct FROM (SELECT count(*) AS total, count(genome_accession) AS g, count(optimal_temperature_c) AS t, count(optimal_ph) AS p,
  count(oxygen_requirement) AS o, count(*) FILTER (WHERE optimal_ph IS NOT NULL AND salt_tolerance_pct IS NOT NULL) AS b FROM phenotypes),
LATERAL (VALUES ('genome_accession', g), ('optimal_temperature_c', t), ('optimal_ph', p), ('oxygen_requirement', o), ('optimal_ph+salt_tolerance_pct', b)) v(field, n)""",
)
def label_coverage(spark, folder):
    return rounded(
        A.coverage(
            phenotypes(spark, folder),
            ["genome_accession", "optimal_temperature_c", "optimal_ph", "oxygen_requirement"],
            ["optimal_ph", "salt_tolerance_pct"],
        )
    )


@query(
    "replicate_by_accession",
    with_sql(STRAINS_SQL)
    + f"""SELECT user_id AS bacdive_id, last_type AS genome_accession, n, {r('total')} AS total FROM
 (SELECT user_id, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id)
 JOIN (SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type) ON event_type = last_type""",
)
def replicate_by_accession(spark, folder):
    events = table(spark, folder, "events")
    per_type = events.groupBy(F.col("event_type").alias("genome_accession")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    listed = events.select(
        F.col("user_id").alias("bacdive_id"), F.col("event_type").alias("genome_accession"), "event_id"
    )
    return rounded(
        J.replicate_by_accession(listed, lambda acc: acc.join(per_type, "genome_accession"), ["event_id"])
    )


@query(
    "attach_taxonomy",
    with_sql(STRAINS_SQL)
    + "SELECT o_orderkey, o_custkey AS bacdive_id, genus, family FROM orders LEFT JOIN strains ON o_custkey = bacdive_id",
)
def attach_taxonomy(spark, folder):
    predictions = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("bacdive_id"))
    return J.attach_taxonomy(predictions, strains(spark, folder))


@query("keep_last_event", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_last_event(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return W.keep_last(events, ["user_id"], ["event_id"])


@query("keep_first_event", "SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_first_event(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return W.keep_first(events, ["user_id"], ["event_id"])


@query(
    "tag_counts",
    """SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type || '|' || replace(p_name, ' ', '|'), '|')) AS tag FROM part) GROUP BY tag""",
)
def tag_counts(spark, folder):
    tagged = table(spark, folder, "part").select(
        F.concat("p_type", F.lit("|"), F.replace(F.col("p_name"), F.lit(" "), F.lit("|"))).alias("tags")
    )
    return A.tag_counts(tagged, "tags")


@query("top_part_names", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 30")
def top_part_names(spark, folder):
    return A.top_values(table(spark, folder, "part"), ["p_name"], 30)


@query(
    "intersect_keys",
    "SELECT o_custkey AS bacdive_id FROM orders INTERSECT SELECT user_id FROM events",
)
def intersect_keys(spark, folder):
    return J.shared_keys(
        table(spark, folder, "orders").select(F.col("o_custkey").alias("bacdive_id")),
        table(spark, folder, "events").select(F.col("user_id").alias("bacdive_id")),
        "bacdive_id",
    )


@query(
    "pending_tasks",
    "SELECT c_custkey AS bacdive_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def pending_tasks(spark, folder):
    done = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("bacdive_id"))
    return J.pending(table(spark, folder, "customer").select(F.col("c_custkey").alias("bacdive_id")), done, ["bacdive_id"])


@query(
    "union_by_name",
    """SELECT c_custkey AS id, c_name AS name, NULL::double AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def union_by_name(spark, folder):
    first = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    second = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    return J.union_chunks(first, second)


@query("common_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def common_columns(spark, folder):
    orders = table(spark, folder, "orders")
    other = orders.select("o_totalprice", F.lit(1).alias("extra"), "o_orderkey").limit(1)
    return orders.select(*J.common_columns(orders, other))


# --- marker hits ------------------------------------------------------------

HITS = with_sql(HITS_SQL)


@query("significant_hits", HITS + "SELECT genome_accession, count(*) AS n FROM hits WHERE evalue <= 1e-5 GROUP BY 1")
def significant_hits(spark, folder):
    return P.significant_hits(hits(spark, folder)).groupBy("genome_accession").agg(F.count(F.lit(1)).alias("n"))


THRESHOLDS_SQL = """
thresholds AS (SELECT profile AS ko, CASE WHEN marker_no % 5 = 0 THEN 0.0 ELSE marker_no::double / 2 END AS threshold FROM markers WHERE marker_no % 4 <> 0),
kept AS (SELECT h.* FROM hits h LEFT JOIN thresholds t ON t.ko = h.profile WHERE evalue <= 1e-5 AND score >= coalesce(threshold, 0))
"""


def thresholds(spark, folder):
    """Profile thresholds keyed by the parts whose number names the profile."""
    names = F.array(*[F.lit(p) for p, _, _ in values.marker_rows()])
    i = F.col("p_partkey") % 50
    listed = table(spark, folder, "part").filter((i < 48) & (i % 4 != 0)).select(
        F.get(names, i.cast("int")).alias("ko"),
        F.when(i % 5 == 0, "-").otherwise((i / 2).cast("string")).alias("threshold"),
    ).distinct()
    from cultiva.sources.annotations import ko_thresholds

    return ko_thresholds(listed)


@query(
    "ko_hits",
    with_sql(HITS_SQL, THRESHOLDS_SQL) + "SELECT genome_accession, profile, count(*) AS n FROM kept GROUP BY ALL",
)
def ko_hits(spark, folder):
    kept = P.ko_hits(hits(spark, folder), thresholds(spark, folder))
    return kept.groupBy("genome_accession", "profile").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hit_sets",
    with_sql(HITS_SQL, THRESHOLDS_SQL)
    + "SELECT genome_accession, string_agg(DISTINCT profile, '|' ORDER BY profile) AS ko_hits FROM kept GROUP BY 1",
)
def hit_sets(spark, folder):
    found = A.collect_hits(P.ko_hits(hits(spark, folder), thresholds(spark, folder)))
    return found.select("genome_accession", F.array_join("ko_hits", "|").alias("ko_hits"))


SUMMARY_SQL = """
summary AS (
  SELECT genome_accession, marker, count(*) AS n_hits, greatest(max(score), 0) AS top_score,
         coalesce(min(evalue) FILTER (WHERE score > 0 AND score = best), 1.0) AS top_evalue
  FROM (SELECT h.*, m.marker, max(score) OVER (PARTITION BY genome_accession, m.marker) AS best
        FROM hits h JOIN markers m USING (profile) WHERE evalue <= 1e-5) GROUP BY ALL)
"""


def marker_hits(spark, folder):
    return J.with_category(hits(spark, folder))


@query(
    "marker_summary",
    with_sql(HITS_SQL, SUMMARY_SQL)
    + f"SELECT genome_accession, marker, n_hits, top_score, {r('top_evalue', 10)} AS top_evalue FROM summary",
)
def marker_summary(spark, folder):
    return rounded(A.marker_summary(marker_hits(spark, folder)), 10)


MARKER_CELLS = ", ".join(
    f"""coalesce(max(n_hits) FILTER (WHERE marker = '{m}'), 0)::double AS "hmm_{m}_n", coalesce(max(top_score) FILTER (WHERE marker = '{m}'), 0)::double AS "hmm_{m}_score",
    (coalesce(max(n_hits) FILTER (WHERE marker = '{m}'), 0) > 0)::int::double AS "hmm_{m}_present" """
    for _, m, _ in values.marker_rows()
)
WIDE_MARKERS_SQL = f"""
wide AS (SELECT g.genome_accession, {MARKER_CELLS} FROM genomes g LEFT JOIN summary USING (genome_accession) GROUP BY 1)
"""


def wide_markers(spark, folder):
    return A.marker_pivot(genomes(spark, folder), A.marker_summary(marker_hits(spark, folder)))


@query("marker_pivot", with_sql(HITS_SQL, SUMMARY_SQL, GENOMES_SQL, WIDE_MARKERS_SQL) + "SELECT * FROM wide")
def marker_pivot(spark, folder):
    return wide_markers(spark, folder)


AEROBIC = [m for _, m, _ in values.marker_rows() if m.endswith("_aerobic")]
ANAEROBIC = [m for _, m, _ in values.marker_rows() if m.endswith("_anaerobic")]
BALANCE_SQL = f"""
balance AS (SELECT genome_accession, {' + '.join(f'"hmm_{m}_present"' for m in AEROBIC)} AS n_aerobic_markers,
  {' + '.join(f'"hmm_{m}_present"' for m in ANAEROBIC)} AS n_anaerobic_markers FROM wide)
"""


def balance(spark, folder):
    balanced = A.marker_balance(wide_markers(spark, folder), AEROBIC, ANAEROBIC)
    return balanced.select("genome_accession", "n_aerobic_markers", "n_anaerobic_markers")


@query(
    "marker_balance",
    with_sql(HITS_SQL, SUMMARY_SQL, GENOMES_SQL, WIDE_MARKERS_SQL, BALANCE_SQL) + "SELECT * FROM balance",
)
def marker_balance(spark, folder):
    return balance(spark, folder)


@query(
    "marker_by_class",
    with_sql(HITS_SQL, SUMMARY_SQL, GENOMES_SQL, WIDE_MARKERS_SQL, BALANCE_SQL, STRAINS_SQL, PHENOTYPES_SQL)
    + f"""SELECT oxygen_requirement, count(*) AS n, {r('avg(n_aerobic_markers)')} AS mean_aerobic, {r('avg(n_anaerobic_markers)')} AS mean_anaerobic
FROM balance JOIN phenotypes USING (genome_accession) WHERE oxygen_requirement IS NOT NULL GROUP BY 1""",
)
def marker_by_class(spark, folder):
    labels = phenotypes(spark, folder).select("genome_accession", "oxygen_requirement")
    return rounded(A.marker_by_class(balance(spark, folder), labels))


@query(
    "marker_category_counts",
    with_sql(HITS_SQL) + "SELECT category, marker, count(*) AS n FROM hits JOIN markers USING (profile) GROUP BY ALL",
)
def marker_category_counts(spark, folder):
    return marker_hits(spark, folder).groupBy("category", "marker").agg(F.count(F.lit(1)).alias("n"))




@query(
    "shortest_per_category",
    """WITH h AS (SELECT DISTINCT source AS genome_accession, lang AS category, doc_id AS protein_idx, text AS aa FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY genome_accession, category ORDER BY length(aa), protein_idx)::int AS rank FROM h)
SELECT genome_accession, category, rank, protein_idx, md5(substr(aa, 1, 1022)) AS aa FROM ranked WHERE rank <= 16""",
)
def shortest_per_category(spark, folder):
    docs = table(spark, folder, "documents")
    named = docs.select(F.col("source").alias("genome_accession"), F.col("lang").alias("category"), F.col("doc_id").alias("protein_idx"), F.col("text").alias("aa"))
    # every document is hit twice, as markers of one category often overlap
    doubled = named.select("genome_accession", "category", "protein_idx").union(
        named.select("genome_accession", "category", "protein_idx")
    )
    kept = W.shortest_per_category(doubled, named.select("genome_accession", "protein_idx", "aa"))
    return kept.withColumn("aa", F.md5("aa"))


@query(
    "sequences_by_category",
    """WITH h AS (SELECT source AS genome_accession, CASE lang WHEN 'en' THEN 'oxygen' WHEN 'de' THEN 'salt' ELSE 'carbon' END AS category, doc_id AS protein_idx, text AS aa FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY genome_accession, category ORDER BY length(aa), protein_idx)::int AS rank FROM h)
SELECT genome_accession, (count(*) FILTER (WHERE category = 'oxygen'))::int AS n_oxygen, (count(*) FILTER (WHERE category = 'salt'))::int AS n_salt,
  (count(*) FILTER (WHERE category = 'carbon'))::int AS n_carbon, 0 AS n_ph, coalesce(md5(string_agg(substr(aa, 1, 1022), '|' ORDER BY rank) FILTER (WHERE category = 'oxygen')), md5('')) AS oxygen
FROM ranked WHERE rank <= 16 GROUP BY 1""",
)
def sequences_by_category(spark, folder):
    category = F.when(F.col("lang") == "en", "oxygen").when(F.col("lang") == "de", "salt").otherwise("carbon")
    named = table(spark, folder, "documents").select(
        F.col("source").alias("genome_accession"), category.alias("category"), F.col("doc_id").alias("protein_idx"), F.col("text").alias("aa")
    )
    kept = W.shortest_per_category(named.drop("aa"), named.drop("category"))
    maps = W.sequences_by_category(kept)
    counts = F.col("category_counts")
    return maps.select(
        "genome_accession", counts["oxygen"].alias("n_oxygen"), counts["salt"].alias("n_salt"),
        counts["carbon"].alias("n_carbon"), counts["ph"].alias("n_ph"),
        F.md5(F.array_join(F.col("by_category")["oxygen"], "|")).alias("oxygen"),
    )


@query(
    "best_assembly",
    """SELECT l_suppkey, min_by(l_orderkey, lvl * 1000000000000 + l_orderkey * 100 + l_linenumber) AS l_orderkey, min(lvl)::int AS level_rank FROM
 (SELECT *, CASE l_shipmode WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 99 END AS lvl FROM (SELECT *, l_partkey % 7 AS l_shipmode FROM lineitem)) GROUP BY l_suppkey""",
)
def best_assembly(spark, folder):
    levels = ["Complete Genome", "Chromosome", "Scaffold", "Contig", "other", "", "Unknown"]
    listed = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber",
        F.get(F.array(*[F.lit(x) for x in levels]), (F.col("l_partkey") % 7).cast("int")).alias("level"),
    )
    best = W.best_assembly(listed, ["l_suppkey"], ["l_orderkey", "l_linenumber"])
    rank = F.when(F.col("level") == "Complete Genome", 0).when(F.col("level") == "Chromosome", 1).when(
        F.col("level") == "Scaffold", 2
    ).when(F.col("level") == "Contig", 3).otherwise(99)
    return best.select("l_suppkey", "l_orderkey", rank.alias("level_rank"))


@query(
    "file_coverage",
    f"""SELECT count(*) AS unique_accessions, count(*) FILTER (WHERE s IS NOT NULL) AS present_fastas, count(*) FILTER (WHERE s IS NULL) AS missing_fastas,
  {r('100.0 * count(*) FILTER (WHERE s IS NOT NULL) / count(*)')} AS coverage_pct
FROM (SELECT DISTINCT 'GCA_' || user_id::varchar AS a FROM events) LEFT JOIN (SELECT DISTINCT 'GCA_' || s_suppkey::varchar AS s FROM supplier WHERE s_suppkey % 4 <> 3) ON a = s""",
)
def file_coverage(spark, folder):
    wanted = table(spark, folder, "events").select(F.concat(F.lit("GCA_"), "user_id").alias("genome_accession"))
    suffix = F.get(F.array(F.lit(".fna"), F.lit(".fa.gz"), F.lit(".fasta"), F.lit(".txt")), (F.col("s_suppkey") % 4).cast("int"))
    files = table(spark, folder, "supplier").select(F.concat(F.lit("GCA_"), "s_suppkey", suffix).alias("file_name"))
    return rounded(A.file_coverage(wanted, files))
