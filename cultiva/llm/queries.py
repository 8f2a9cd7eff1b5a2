"""Registered queries of the subpackage: the given tables mapped to the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva.llm.byte_bpe import bpe_decode, bpe_encode
from cultiva.llm.fingerprints import hexadecimal, near_fingerprints, text_fingerprints
from cultiva.llm.flat_graph import embedding_duplicates
from cultiva.llm.fuzzy_lines import remove_fuzzy_lines
from cultiva.llm.jaccard import jaccard_components
from cultiva.llm.line_quality import fit_line_field, score_lines
from cultiva.llm.packing import pack, token_pieces
from cultiva.llm.periodic_runs import periodic_runs
from cultiva.llm.private_data import KINDS, find_private_data
from cultiva.llm.repetition import repetition_profile
from cultiva.llm.substrings import remove_repeated_windows
from cultiva.llm.tables import written
from cultiva.llm.token_counts import token_counts
from cultiva.llm.whitening import whitened_embeddings
from suite.base import Query, table

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Query(run, sql)
        return run

    return register


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as isolation texts of strains."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("bacdive_id"), F.col("text").alias("iso_sample_text")
    )


WORD = r"[^\x20\x09-\x0D]+"

REPETITION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (
  SELECT rid, m, list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')) AS gs
  FROM d, (SELECT unnest([3, 8]) AS m) WHERE len(w) >= m),
placed AS (SELECT rid, m, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM grams),
seen AS (SELECT rid, m, i, g, count(*) OVER (PARTITION BY rid, m, g) AS n FROM placed),
twice AS (SELECT rid, m, i, g FROM seen WHERE n > 1),
cover AS (
  SELECT rid, m, count(DISTINCT i + k) AS n
  FROM (SELECT rid, m, i, unnest(range(0, m)) AS k FROM twice) GROUP BY rid, m),
open AS (
  SELECT d.rid FROM d JOIN cover c3 ON d.rid = c3.rid AND c3.m = 3 JOIN cover c8 ON d.rid = c8.rid AND c8.m = 8
  WHERE len(w) >= 50 AND 100 * c3.n <= 50 * len(w) AND 100 * c8.n <= 50 * len(w)),
diagonal AS (
  SELECT a.rid, a.i, b.i - a.i AS d,
         a.i - row_number() OVER (PARTITION BY a.rid, b.i - a.i ORDER BY a.i) AS run
  FROM twice a JOIN twice b ON a.rid = b.rid AND a.m = 8 AND b.m = 8 AND a.g = b.g AND a.i < b.i
  WHERE a.rid IN (SELECT rid FROM open)),
longest AS (
  SELECT rid, max(n) + 7 AS n FROM (SELECT rid, d, run, count(*) AS n FROM diagonal GROUP BY rid, d, run)
  GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT rid, sum(n - 1) AS n FROM (
    SELECT rid, line, count(*) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY rid, line)
  GROUP BY rid),
counted AS (
  SELECT d.rid, doc_id, len(w)::bigint AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         coalesce(dup.n, 0)::bigint AS n_dup_lines, coalesce(c3.n, 0)::bigint AS n_repeat_words,
         coalesce(c8.n, 0)::bigint AS n_covered_words, coalesce(longest.n, 0) AS longest
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN longest USING (rid)
  LEFT JOIN cover c3 ON d.rid = c3.rid AND c3.m = 3 LEFT JOIN cover c8 ON d.rid = c8.rid AND c8.m = 8),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
       NOT base_failed AND 100 * n_covered_words <= 50 * n_words AND 100 * longest <= 30 * n_words AS kept
FROM judged
"""

SUBSTRING_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (
  SELECT rid, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' '))) AS gs
  FROM d WHERE len(w) >= 35),
placed AS (SELECT rid, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM grams),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM placed),
gone AS (SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i, unnest(range(0, 35)) AS k FROM seen WHERE n > 1)),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y
  ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (
  SELECT vec_id, vec_id AS other FROM e
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted ON vec_id = a
"""

# CRC-32 of a string of ASCII characters: bytes in turn, eight shifts after each.
CRC_SQL = """list_reduce(
  [4294967295::bigint] || flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::bigint] || repeat([-1::bigint], 8))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)"""

RUNS_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         xor({CRC_SQL.format("doc_id::varchar")}, 4294967295) AS h FROM documents),
turned AS (
  SELECT rid, doc_id, len(w) AS n,
         CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(0, len(w)), lambda i: w[1 + CASE
           WHEN i < (h // 10) % len(w) THEN i
           ELSE (h // 10) % len(w) + (i - (h // 10) % len(w))
                % (1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM d),
words AS (SELECT rid, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM turned),
pairs AS (
  SELECT a.rid, a.i, b.i - a.i AS p FROM words a JOIN words b
  ON a.rid = b.rid AND a.word = b.word AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
chained AS (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS chain FROM pairs),
stretches AS (
  SELECT rid, p, min(i) AS s, count(*) + p AS l FROM chained GROUP BY rid, p, chain
  HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT rid, s, l, min(p) AS p FROM stretches GROUP BY rid, s, l),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t
  FROM runs GROUP BY rid),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l / p DESC, s, p) AS k FROM runs),
gone AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(s + p, s + l)) AS i FROM runs)),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, s::bigint AS start, l::bigint AS length,
       p::bigint AS period, (1000 * l // p)::bigint AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM turned LEFT JOIN listed USING (rid) LEFT JOIN best ON turned.rid = best.rid AND k = 1
LEFT JOIN kept ON turned.rid = kept.rid
"""

SIMHASH_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
follows AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id)),
edits AS (
  SELECT doc_id, next_id, text, length(text) AS n,
         substr(text, 1, length(text) - length(text) // 4) || substr(next, 1, length(text) // 4) AS edited
  FROM follows),
versions AS (SELECT doc_id, 0 AS v, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
words AS (SELECT doc_id, v, regexp_extract_all(text, '{WORD}') AS w FROM versions),
terms AS (
  SELECT doc_id, v, unnest(CASE WHEN len(w) > 1
    THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS t FROM words),
hashed AS (
  SELECT doc_id, v, ('0x' || substr(md5(t), 1, 16))::ubigint AS h, least(length(t), 64) AS weight FROM terms),
votes AS (
  SELECT doc_id, v, sum(weight) AS total,
         {", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN weight ELSE 0 END) AS b{i}" for i in range(64))}
  FROM hashed GROUP BY doc_id, v),
prints AS (
  SELECT doc_id, v, ({" + ".join(f"CASE WHEN 2 * b{i} > total THEN {1 << i}::hugeint ELSE 0 END" for i in range(64))})::ubigint AS f
  FROM votes),
pairs AS (
  SELECT edits.*, coalesce(a.f, 0) AS f, coalesce(b.f, 0) AS g FROM edits
  LEFT JOIN prints a ON edits.doc_id = a.doc_id AND a.v = 0 LEFT JOIN prints b ON edits.doc_id = b.doc_id AND b.v = 1),
near AS (
  SELECT x.doc_id, count(*) AS n_near, nullif(min(CASE WHEN x.f = y.f THEN 99 ELSE bit_count(xor(x.f, y.f)::hugeint) END), 99) AS nearest
  FROM pairs x JOIN pairs y ON x.doc_id % 20 = 0 AND bit_count(xor(x.f, y.f)::hugeint) <= 3 GROUP BY x.doc_id)
SELECT pairs.doc_id, pairs.n AS n_chars, sha256(pairs.edited) AS edited_sha256,
       lower(lpad(to_hex(pairs.f), 16, '0')) AS fingerprint, lower(lpad(to_hex(pairs.g), 16, '0')) AS edited_fingerprint,
       greatest(0.0, round(cos(pi() * bit_count(xor(pairs.f, pairs.g)::hugeint) / 64), 6)) AS near_edited,
       greatest(0.0, round(cos(pi() * bit_count(xor(pairs.f, c.f)::hugeint) / 64), 6)) AS near_next,
       n_near::bigint AS n_near, nearest::int AS nearest
FROM pairs JOIN pairs c ON pairs.next_id = c.doc_id LEFT JOIN near ON pairs.doc_id = near.doc_id
"""


def turned(texts: DataFrame) -> DataFrame:
    """The words of some texts go round, as the contract of op11 has it."""
    h = F.crc32(F.col("bacdive_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("iso_sample_text", F.lit("")), F.lit(WORD), 0)
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    place = F.sequence(F.lit(0), n - 1)
    moved = F.transform(place, lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")))
    chosen = texts.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    return chosen.withColumn(
        "iso_sample_text", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("iso_sample_text"))
    ).drop("_h", "_words")


@query("op4_suffix_array_repetition", REPETITION_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Longest repeats under 8 words never decide: 15 words is 30 % of the least length."""
    profile = repetition_profile(samples(spark, folder))
    return profile.withColumnRenamed("bacdive_id", "doc_id").drop("longest_repeat")


@query("op5_transducer_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(samples(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumnRenamed("bacdive_id", "doc_id")


@query("op8_merge_replay_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe_decode(bpe_encode(samples(spark, folder), ranks), ranks)
    return decoded.select(
        F.col("bacdive_id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def joined_spans(spans):
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_deobfuscated_private_data")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = find_private_data(samples(spark, folder))
    plain = F.filter("found", lambda s: s["plain"])
    return found.select(
        F.col("bacdive_id").alias("doc_id"),
        *[
            F.size(F.array_remove(F.transform(plain, lambda s: s["kind"] != kind), True)).cast("long").alias(
                f"n_{kind}"
            )
            for kind in KINDS
        ],
        F.sha2(joined_spans(plain), 256).alias("base_sha256"),
        joined_spans("found").alias("spans"),
    )


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_pieces(samples(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select(
        F.col("bacdive_id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(digests)


@query("op1_line_field_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("bacdive_id").cast("string")) % 5 == 0
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("bacdive_id"), "quality")
    texts = samples(spark, folder)
    field = fit_line_field(texts, labels.filter(~held_out))
    return score_lines(texts, field).select(
        F.col("bacdive_id").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op7_count_min_substrings", SUBSTRING_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_windows(samples(spark, folder))
    return kept.select(
        F.col("bacdive_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op10_grouped_prefix_jaccard")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_components(samples(spark, folder))
    return found.select(F.col("bacdive_id").alias("doc_id"), "n_shingles", "component_id")


@query("op2_flat_graph_duplicates", EMBEDDING_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("genome_accession"), "embedding")
    return embedding_duplicates(vectors).withColumnRenamed("genome_accession", "vec_id")


@query("op6_simhash_fuzzy_lines")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_fuzzy_lines(samples(spark, folder), digits=True)
    return kept.select(
        F.col("bacdive_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op11_dyadic_square_runs", RUNS_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(turned(samples(spark, folder)))

    def steeper(x, y):
        """By falling exponent (cross products, no rounding), then start, then period."""
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        tie = F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(
            F.signum(x["period"] - y["period"])
        )
        return F.when(left > right, -1).when(left < right, 1).otherwise(tie).cast("int")

    best = F.get(F.array_sort("runs", steeper), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        F.col("bacdive_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("_best").getField(c).alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@query("op12_simhash_fingerprints", SIMHASH_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents; every twentieth is searched for among all."""
    found = written(text_fingerprints(samples(spark, folder)))
    asked = F.col("bacdive_id") % 20 == 0
    near = near_fingerprints(found.filter(asked), found)
    joined = found.join(near, "simhash", "left")
    return joined.select(
        F.col("bacdive_id").alias("doc_id"),
        "n_chars",
        F.col("edited_text_sha256").alias("edited_sha256"),
        hexadecimal(F.col("simhash")).alias("fingerprint"),
        hexadecimal(F.col("edited_simhash")).alias("edited_fingerprint"),
        F.col("likeness_edited").alias("near_edited"),
        F.col("likeness_next").alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
        F.when(asked, F.col("nearest")).alias("nearest"),
    )


@query("op13_sliced_spectrum_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("genome_accession"), "embedding")
    return whitened_embeddings(vectors).withColumnRenamed("genome_accession", "vec_id")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
