"""Pathway rules: nations are modules, parts bought by a customer are its profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.operators import rules as R
from cultiva.operators.aggregates import module_prevalence
from cultiva.sources.annotations import parse_modules
from suite.base import lines, query, r, rounded, table, with_sql

# Every nation has a rule over five profiles a..e derived from its key; the shape
# depends on the key as well.
SHAPES = [
    "{a} ({b},{c}) {d}",
    "({a} {b},{c})",
    "{a}+{b}-{c}",
    "({a} ({b},({c} {d}))),{e}",
    "{a},{b} M00001 {c}",
    "(({a},{b}) ({c},{d})) {e}",
    "{a} ,{b}",
    "{a}) {b}",
]
NODES_SQL = """
modules AS (
  SELECT 'M' || lpad(n_nationkey::varchar, 5, '0') AS module, n_nationkey % 8 AS shape,
         'K' || lpad((n_nationkey % 40)::varchar, 5, '0') AS a, 'K' || lpad(((n_nationkey * 3 + 1) % 40)::varchar, 5, '0') AS b,
         'K' || lpad(((n_nationkey * 5 + 2) % 40)::varchar, 5, '0') AS c, 'K' || lpad(((n_nationkey * 7 + 3) % 40)::varchar, 5, '0') AS d,
         'K' || lpad(((n_nationkey * 11 + 4) % 40)::varchar, 5, '0') AS e FROM nation),
ko AS (
  SELECT DISTINCT 'GCA_' || o_custkey::varchar AS genome_accession, 'K' || lpad((l_partkey % 40)::varchar, 5, '0') AS ko
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
held AS (
  SELECT g.genome_accession, module, shape,
    (a IN (SELECT ko FROM ko k WHERE k.genome_accession = g.genome_accession))::int AS a, (b IN (SELECT ko FROM ko k WHERE k.genome_accession = g.genome_accession))::int AS b,
    (c IN (SELECT ko FROM ko k WHERE k.genome_accession = g.genome_accession))::int AS c, (d IN (SELECT ko FROM ko k WHERE k.genome_accession = g.genome_accession))::int AS d,
    (e IN (SELECT ko FROM ko k WHERE k.genome_accession = g.genome_accession))::int AS e
  FROM (SELECT DISTINCT genome_accession FROM ko) g CROSS JOIN modules),
scored AS (
  SELECT genome_accession, module,
    CASE shape WHEN 0 THEN (a + greatest(b, c) + d) / 3.0 WHEN 1 THEN (a + greatest(b, c)) / 2.0 WHEN 2 THEN (a + b + c) / 3.0
      WHEN 3 THEN greatest((a + greatest(b, (c + d) / 2.0)) / 2.0, e) WHEN 4 THEN (greatest(a, b) + c) / 2.0
      WHEN 5 THEN ((greatest(a, b) + greatest(c, d)) / 2.0 + e) / 2.0 WHEN 6 THEN (a + 0 + b) / 3.0 ELSE a END AS completeness,
    CASE shape WHEN 0 THEN least(a, greatest(b, c), d) WHEN 1 THEN least(a, greatest(b, c)) WHEN 2 THEN least(a, b, c)
      WHEN 3 THEN greatest(least(a, greatest(b, least(c, d))), e) WHEN 4 THEN least(greatest(a, b), c)
      WHEN 5 THEN least(greatest(a, b), greatest(c, d), e) WHEN 6 THEN 0 ELSE a END::double AS strict
  FROM held)
"""
SQL = with_sql(NODES_SQL)


def modules(spark, folder):
    """Module rows; shape, profiles and name follow from the nation."""
    k = F.col("n_nationkey")
    letters = {"a": k % 40, "b": (k * 3 + 1) % 40, "c": (k * 5 + 2) % 40, "d": (k * 7 + 3) % 40, "e": (k * 11 + 4) % 40}
    definition = F.get(F.array(*[F.lit(s) for s in SHAPES]), k % 8)
    for name, number in letters.items():
        profile = F.concat(F.lit("K"), F.lpad(number.cast("string"), 5, "0"))
        definition = F.replace(definition, F.lit("{" + name + "}"), profile)
    return table(spark, folder, "nation").select(
        F.concat(F.lit("M"), F.lpad(k.cast("string"), 5, "0")).alias("id"), definition.alias("definition"), "n_name"
    )


def profile_hits(spark, folder):
    return (
        lines(spark, folder, "l_orderkey", "l_partkey")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(F.lit("GCA_"), F.col("o_custkey").cast("string")).alias("genome_accession"),
            F.concat(F.lit("K"), F.lpad((F.col("l_partkey") % 40).cast("string"), 5, "0")).alias("ko"),
        )
    )


def completeness(spark, folder, fractional=True):
    return R.module_completeness(profile_hits(spark, folder), R.rule_nodes(modules(spark, folder)), fractional)


@query(
    "module_completeness",
    SQL + f"SELECT genome_accession, module, {r('completeness')} AS completeness FROM scored WHERE completeness > 0",
)
def module_completeness(spark, folder):
    return rounded(completeness(spark, folder))


@query(
    "module_completeness_strict",
    SQL + "SELECT genome_accession, module, strict AS completeness FROM scored WHERE strict > 0",
)
def module_completeness_strict(spark, folder):
    return completeness(spark, folder, fractional=False)


NAMES = [f"M{i:05d}" for i in range(25)]


@query(
    "module_matrix",
    SQL
    + "SELECT genome_accession, "
    + ", ".join(f"{r(f'''max(completeness) FILTER (WHERE module = '{m}')''')} AS \"kegg_{m}\"" for m in NAMES)
    + " FROM scored GROUP BY 1",
)
def module_matrix(spark, folder):
    hits = profile_hits(spark, folder)
    return rounded(R.module_matrix(hits.select("genome_accession"), completeness(spark, folder), NAMES))


@query(
    "module_prevalence",
    SQL
    + f"SELECT module, {r('avg(completeness)')} AS mean_completeness FROM scored GROUP BY module ORDER BY round(avg(completeness), 9) DESC, module LIMIT 10",
)
def module_prevalence_query(spark, folder):
    n = profile_hits(spark, folder).agg(F.count_distinct("genome_accession")).scalar()
    return rounded(module_prevalence(completeness(spark, folder), n))


@query(
    "rule_node_counts",
    """SELECT 'M' || lpad(n_nationkey::varchar, 5, '0') AS module, [4, 3, 3, 5, 3, 5, 3, 1][n_nationkey % 8 + 1]::bigint AS n_leaves,
  [1, 1, 0, 3, 0, 3, 0, 0][n_nationkey % 8 + 1]::bigint AS n_brackets, [3, 1, 3, 1, 2, 2, 3, 1][n_nationkey % 8 + 1]::bigint AS n_steps FROM nation""",
)
def rule_node_counts(spark, folder):
    nodes = R.rule_nodes(modules(spark, folder))
    return nodes.groupBy("module").agg(
        F.count_if(F.col("kind") == "leaf").alias("n_leaves"),
        F.count_if((F.col("kind") == "and") & (F.col("node") > 0)).alias("n_brackets"),
        F.max(F.when(F.col("node") == 0, F.col("n_children"))).alias("n_steps"),
    )


@query(
    "hit_records_first_wins",
    """SELECT 'U' || user_id AS genome_accession, count(DISTINCT ko) AS n FROM (
  SELECT user_id, min_by(event_type, event_id) AS ko FROM events GROUP BY user_id) GROUP BY 1""",
)
def hit_records_first_wins(spark, folder):
    records = table(spark, folder, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("U"), "user_id")).alias("genome_accession"),
        F.concat(F.lit("U"), "user_id").alias("accession"),
        F.array("event_type", "event_type").alias("ko_hits"),
        F.col("event_id").alias("line"),
    )
    return R.hit_sets(records).groupBy("genome_accession").agg(F.count_distinct("ko").alias("n"))


@query(
    "module_flatfile",
    """SELECT 'M' || lpad(p_partkey::varchar, 5, '0') AS id, p_name AS name, 'K' || lpad(p_size::varchar, 5, '0') || ' K00001 (K' || lpad((p_size + 1)::varchar, 5, '0') || ',K00001)' AS definition,
  CASE WHEN p_size = 1 THEN 'K00001|K00002' ELSE 'K00001|K' || lpad(p_size::varchar, 5, '0') || '|K' || lpad((p_size + 1)::varchar, 5, '0') END AS ko_list,
  'Pathway; ' || p_type || ' modules' AS category FROM part WHERE p_partkey % 7 <> 0""",
)
def module_flatfile(spark, folder):
    rows = parse_modules(module_records(spark, folder))
    return rows.withColumn("ko_list", F.array_join("ko_list", "|"))


def module_records(spark, folder):
    """Parts as records of a module flat file."""
    k, size = F.col("p_partkey"), F.col("p_size")
    profile = lambda n: F.concat(F.lit("K"), F.lpad(n.cast("string"), 5, "0"))
    definition = F.when(
        k % 7 != 0,
        F.concat(F.lit("DEFINITION  "), profile(size), F.lit(" K00001\n            ("), profile(size + 1), F.lit(",K00001)\n")),
    ).otherwise("")
    record = F.concat(
        F.lit("ENTRY       M"), F.lpad(k.cast("string"), 5, "0"), F.lit("   Pathway   Module\nNAME        "), "p_name", F.lit("\n"),
        definition, F.lit("CLASS       Pathway;\n            "), "p_type", F.lit(" modules\nORTHOLOGY   K99999\n"),
    )
    return table(spark, folder, "part").select(record.alias("value"))
