"""Embedding vectors: pooling, category pooling, flattening and class scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cultiva.functions import vectors as VF
from cultiva.operators import vectors as V
from suite.base import query, r, rounded, table

LENGTH = 64
CATEGORY = ["oxygen", "salt", "ph", "carbon"]
VECTORS_SQL = """
WITH vectors AS (
  SELECT 'G' || (vec_id % 37)::varchar AS genome_accession, vec_id AS protein_idx, embedding, ['oxygen', 'salt', 'ph', 'carbon'][label % 4 + 1] AS category FROM embeddings),
long AS (SELECT genome_accession, protein_idx, category, unnest(range(0, 64))::int AS i, unnest(embedding)::double AS x FROM vectors)
"""


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.concat(F.lit("G"), (F.col("vec_id") % 37).cast("string")).alias("genome_accession"),
        F.col("vec_id").alias("protein_idx"),
        "embedding",
        F.get(F.array(*[F.lit(c) for c in CATEGORY]), F.col("label") % 4).alias("category"),
    )


def exploded(df, column="embedding"):
    return rounded(df.select("genome_accession", F.posexplode(column).alias("i", "x")))


@query(
    "mean_pool",
    VECTORS_SQL + f"SELECT genome_accession, i, {r('avg(x)')} AS x FROM long GROUP BY ALL",
)
def mean_pool(spark, folder):
    return exploded(V.mean_pool(vectors(spark, folder), ["genome_accession"]))


@query(
    "mean_pool_with_missing",
    VECTORS_SQL
    + f""", genomes AS (SELECT DISTINCT 'G' || (vec_id % 41)::varchar AS genome_accession FROM embeddings)
SELECT g.genome_accession, s.i::int AS i, {r('coalesce(avg(x), 0)')} AS x, count(x) AS n FROM genomes g CROSS JOIN range(0, 64) s(i)
LEFT JOIN long l ON l.genome_accession = g.genome_accession AND l.i = s.i GROUP BY ALL""",
)
def mean_pool_with_missing(spark, folder):
    genomes = table(spark, folder, "embeddings").select(
        F.concat(F.lit("G"), (F.col("vec_id") % 41).cast("string")).alias("genome_accession")
    )
    pooled = V.mean_pool_all(genomes, vectors(spark, folder), LENGTH)
    return rounded(pooled.select("genome_accession", "n", F.posexplode("embedding").alias("i", "x")))


@query(
    "sample_then_pool",
    """WITH placed AS (
  SELECT 'G' || (vec_id % 37) AS genome_accession, embedding,
         row_number() OVER (PARTITION BY vec_id % 37 ORDER BY md5('7|' || vec_id), vec_id) AS place FROM embeddings),
long AS (SELECT genome_accession, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS i FROM placed WHERE place <= 5)
"""
    + f"SELECT genome_accession, count(*) AS n, i::int AS i, {r('avg(x)')} AS x FROM long GROUP BY genome_accession, i",
)
def sample_then_pool(spark, folder):
    return rounded(
        V.sample_then_pool(vectors(spark, folder), 5, "protein_idx", seed=7).select(
            "genome_accession", "n", F.posexplode("embedding").alias("i", "x")
        )
    )


def pooled(spark, folder):
    df = vectors(spark, folder)
    return V.pool_per_category(df, df.select("genome_accession", "category", "protein_idx"), df.drop("category"), LENGTH)


@query(
    "pool_per_category",
    VECTORS_SQL
    + f"""SELECT g.genome_accession, c.category, count(x) // 64 AS n, (SELECT count(DISTINCT protein_idx) FROM vectors v WHERE v.genome_accession = g.genome_accession) AS total,
  s.i::int AS i, {r("coalesce(avg(x) FILTER (WHERE l.i = s.i), 0)")} AS x
FROM (SELECT DISTINCT genome_accession FROM vectors) g
CROSS JOIN range(0, 64) s(i)
CROSS JOIN (VALUES ('temperature'), ('ph'), ('oxygen'), ('salt'), ('vitamin'), ('nitrogen'), ('carbon'), ('special')) c(category)
LEFT JOIN long l ON l.genome_accession = g.genome_accession AND l.category = c.category GROUP BY ALL""",
)
def pool_per_category(spark, folder):
    wide = pooled(spark, folder)
    entries = [
        F.struct(
            F.lit(c).alias("category"), F.col(f"pme_{c}_n").alias("n"),
            F.col(f"pme_{c}").alias("vector"),
        )
        for c in V.values.CATEGORIES
    ]
    long = wide.select(
        "genome_accession", F.col("pme_marker_proteins_total").alias("total"), F.inline(F.array(*entries))
    )
    return rounded(long.select("genome_accession", "total", "category", "n", F.posexplode("vector").alias("i", "x")))


@query(
    "concat_categories",
    VECTORS_SQL
    + f""", slots AS (SELECT 'temperature' AS category, 0 AS slot UNION ALL SELECT 'ph', 1 UNION ALL SELECT 'oxygen', 2 UNION ALL SELECT 'salt', 3
 UNION ALL SELECT 'vitamin', 4 UNION ALL SELECT 'nitrogen', 5 UNION ALL SELECT 'carbon', 6 UNION ALL SELECT 'special', 7)
SELECT genome_accession, (slot * 64 + i)::int AS i, {r('avg(x)')} AS x FROM long JOIN slots USING (category) GROUP BY ALL HAVING {r('avg(x)')} <> 0""",
)
def concat_categories(spark, folder):
    joined = V.concat_categories(pooled(spark, folder))
    return exploded(joined).filter(F.col("x") != 0)


@query(
    "flatten_vector",
    "SELECT vec_id, " + ", ".join(f"{r(f'embedding[{i + 1}]')} AS emb_{i}" for i in range(LENGTH)) + " FROM embeddings",
)
def flatten_vector(spark, folder):
    df = table(spark, folder, "embeddings")
    doubles = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(doubles.select("vec_id", *VF.flatten(F.col("embedding"), LENGTH, "emb_")))


SOFTMAX_SQL = """
WITH logits AS (
  SELECT vec_id, list_transform([0, 16, 32, 48], lambda b: list_sum(list_transform(embedding[b + 1:b + 16], lambda x: x::double)) * 4) AS z
  FROM embeddings),
p AS (SELECT vec_id, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda y: exp(y)))) AS p FROM logits)
"""


@query(
    "softmax_classes",
    SOFTMAX_SQL
    + f"""SELECT vec_id, ['aerobe', 'anaerobe', 'facultative_anaerobe', 'microaerobe'][list_position(p, list_max(p))] AS pred_oxygen_requirement,
  {r('list_max(p)')} AS pred_oxygen_requirement_confidence, 'model' AS pred_oxygen_requirement_source, {r('p[1]')} AS pred_oxygen_requirement_prob_aerobe,
  {r('p[2]')} AS pred_oxygen_requirement_prob_anaerobe, {r('p[3]')} AS pred_oxygen_requirement_prob_facultative_anaerobe, {r('p[4]')} AS pred_oxygen_requirement_prob_microaerobe FROM p""",
)
def softmax_classes(spark, folder):
    """Every entry counts: the logit of a class is the sum of its block of 16."""
    blocks = [F.slice("embedding", 16 * b + 1, 16) for b in range(4)]
    z = F.array(*[F.aggregate(b, F.lit(0.0), lambda total, x: total + x.cast("double")) * 4 for b in blocks])
    logits = table(spark, folder, "embeddings").select("vec_id", z.alias("logits"))
    return rounded(V.classify(logits, "vec_id", source="model"))
