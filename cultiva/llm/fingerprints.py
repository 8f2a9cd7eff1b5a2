"""SimHash fingerprints of isolation texts, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cultiva.llm.tables import written
from cultiva.operators.ordered import row_index

# Production parameters.
SHINGLE_WORDS = 2
MAX_WEIGHT = 64
RADIUS = 3
# Blocks of the permuted tables: fingerprints within RADIUS agree on BLOCKS - RADIUS of
# them, and every table holds one choice of these.
BLOCKS = 6
# Fingerprints of one permuted table and key that are held as one list.
LISTED = 512

BITS = 64
WORD = r"[^\x20\x09-\x0D]+"
# Bits i and i + 32 of a hash, as two counters of 32 bits.
LANES = 0x100000001


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _term_rows(rows: DataFrame, keys: list[str], text: str, shingle: int) -> DataFrame:
    """``(keys, _term)``: every run of ``shingle`` consecutive words, one row each.

    A text of fewer words is one term; a text without words has one row without a term.
    """
    words = rows.select(*keys, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0).alias("_words"))
    n, parts = F.size("_words"), [f"w{i}" for i in range(shingle)]
    long = F.arrays_zip(*[F.slice("_words", i + 1, n - shingle + 1).alias(p) for i, p in enumerate(parts)])
    blank = F.lit(None).cast("string")
    whole = F.struct(F.array_join("_words", " ").alias("w0"), *[blank.alias(p) for p in parts[1:]])
    zipped = words.select(*keys, F.when(n >= shingle, long).when(n > 0, F.array(whole)).alias("_zipped"))
    spread = zipped.select(*keys, F.explode_outer("_zipped").alias("_t"))
    # concat_ws leaves out what is missing, and gives "" where all is.
    return spread.select(*keys, F.nullif(F.concat_ws(" ", *[F.col("_t")[p] for p in parts]), F.lit("")).alias("_term"))


def term_hash(term: Column) -> Column:
    """The first 64 bits of a term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, 16), 16, -10).cast("bigint")


def simhash(rows: DataFrame, keys: list[str], text: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(keys, simhash)``: the fingerprint of every ``text``, one row per key.

    Every occurrence of a term votes on each bit of the fingerprint with its weight, for
    the bit's value in the term's hash. The weight of a term is its length in
    characters, ``MAX_WEIGHT`` at most: long words are rare ones. A bit is set when
    more than half of the weight votes for it, so a text without words has none.

    The votes of two bits share one sum, which holds for texts up to a gigabyte. They
    are added before the shuffle, a row per key and task; where the rows are already dealt
    by one of ``keys`` there is no shuffle.
    """
    hashed = _term_rows(rows, keys, text, shingle).select(
        *keys,
        F.coalesce(term_hash(F.col("_term")), F.lit(0)).alias("_hash"),
        F.coalesce(F.least(F.length("_term"), F.lit(MAX_WEIGHT)), F.lit(0)).cast("bigint").alias("_weight"),
    )
    votes = [
        F.sum(F.shiftrightunsigned("_hash", i).bitwiseAND(F.lit(LANES)) * F.col("_weight")).alias(f"_votes{i}")
        for i in range(BITS // 2)
    ]
    counted = hashed.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *votes)

    def bit(i: int) -> Column:
        lanes = F.col(f"_votes{i % 32}")
        lane = F.shiftrightunsigned(lanes, 32) if i >= 32 else lanes.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(2 * lane > F.col("_all"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("bigint"))

    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(BITS)]).alias("simhash"))


def hexadecimal(fingerprint: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """The cosine between the term vectors that two fingerprints estimate, 0 at least."""
    return F.greatest(F.lit(0.0), F.round(F.cos(F.lit(3.141592653589793) * distance(a, b) / BITS), 6))


# --- search -------------------------------------------------------------------


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the permuted tables: every choice of ``blocks - radius`` blocks.

    Two fingerprints within ``radius`` differ in that many blocks at most, so they agree
    on all the others and meet in one table at least.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be smaller than the number of blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(block, blocks - radius)]


def near_fingerprints(
    queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """How many texts have a fingerprint within ``radius`` bits of each query.

    ``queries`` and ``fingerprints`` have a column ``simhash``, one row per text. The
    result has a row per distinct query: ``simhash``, ``n_near`` (texts of
    ``fingerprints`` within the radius, equal fingerprints included) and ``nearest``
    (bits to the closest different fingerprint within the radius, else null).

    Equal fingerprints are one entry with a count. An entry stands in every permuted
    table under the blocks that the table's mask leaves. The entries under one key are
    dealt into lists of about ``LISTED``, so a key that very many fingerprints share is
    spread over tasks, and a query meets lists, not single entries: no row is made per
    pair. A pair that meets in several tables counts in the first of them. Null
    fingerprints are ignored.
    """
    masks = block_masks(radius, blocks)

    def placed(rows: DataFrame) -> DataFrame:
        tables = F.array(
            *[F.struct(F.lit(i).alias("at"), F.col("simhash").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]
        )
        return rows.select("*", F.explode(tables).alias("_t")).select(*rows.columns, "_t.at", "_t.key")

    asked = placed(queries.filter("simhash is not null").select("simhash").distinct())
    entries = placed(fingerprints.filter("simhash is not null").groupBy("simhash").agg(F.count(F.lit(1)).alias("n")))
    wanted = entries.join(asked.select("at", "key").distinct(), ["at", "key"], "left_semi")
    sizes = wanted.groupBy("at", "key").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("_lists"))
    lists = (
        wanted.join(sizes, ["at", "key"])
        .groupBy("at", "key", F.pmod(F.xxhash64("simhash"), F.col("_lists")).alias("_list"))
        .agg(F.collect_list(F.struct("simhash", "n")).alias("listed"))
    )
    met = asked.join(lists, ["at", "key"])
    known = F.array(*[F.lit(m) for m in masks])

    def first_meeting(x: Column) -> Column:
        apart = F.col("simhash").bitwiseXOR(x["simhash"])
        earlier = F.slice(known, F.lit(1), F.col("at"))
        return (F.bit_count(apart) <= radius) & F.forall(earlier, lambda m: apart.bitwiseAND(m) != 0)

    near = F.filter("listed", first_meeting)
    others = F.transform(near, lambda x: F.bit_count(F.col("simhash").bitwiseXOR(x["simhash"])))
    found = met.select(
        "simhash",
        F.aggregate(near, F.lit(0).cast("bigint"), lambda total, x: total + x["n"]).alias("n"),
        F.array_min(F.filter(others, lambda d: d > 0)).alias("d"),
    )
    counted = found.groupBy("simhash").agg(F.sum("n").alias("n_near"), F.min("d").alias("nearest"))
    alone = asked.select("simhash").distinct()
    return alone.join(counted, "simhash", "left").select(
        "simhash", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "nearest"
    )


# --- operator -----------------------------------------------------------------

RESULT = [
    "n_chars", "edited_text_sha256", "simhash", "edited_simhash", "next_simhash", "likeness_edited", "likeness_next",
]


def text_fingerprints(
    samples: DataFrame,
    key: str = "bacdive_id",
    text: str = "iso_sample_text",
    shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """SimHash of every isolation text, and how it answers to an edit and to another text.

    One row per input row: ``key``, ``n_chars`` (code points), ``simhash`` (64 bits),
    ``edited_simhash`` and ``edited_text_sha256`` (of the text whose last quarter of code
    points, rounded down, is replaced by as many from the start of the next text, or all
    of it), ``next_simhash``, ``likeness_edited`` and ``likeness_next`` (estimated
    cosine, 0 to 1). Texts follow each other by ``key``, rows of one key and null keys
    (which come first) by a digest of their text; after the last comes the first.

    A null text is an empty one: no words, fingerprint 0. Rows equal in key and text are
    one text, whose row comes back as often as it was given. Other columns are ignored.

    A text is shuffled once, by a digest of its row; the next text travels as the
    quarter that is needed. Only numbers are sorted over the whole table.
    """
    if key in RESULT:
        raise ValueError(f"column of the result: {key}")
    if shingle < 1:
        raise ValueError("a term has one word at least")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit("null"))
    rows = samples.select(
        F.col(f"`{key}`").alias("_key"),
        F.md5(F.concat(name, F.lit("\n"), content)).alias("_row"),
        content.alias("_text"),
    )
    keys = written(
        rows.select("_key", "_row", F.length("_text").cast("bigint").alias("n_chars"))
        .groupBy("_row").agg(F.first("_key").alias("_key"), F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("_times"))
    )
    numbered = written(row_index(keys, [F.col("_key").asc_nulls_first(), "_row"], into="_at", total="_total"))
    before = numbered.select(
        F.pmod(F.col("_at") + 1, F.col("_total")).alias("_at"),
        F.col("_row").alias("_before"),
        F.floor(F.col("n_chars") / 4).alias("_quarter"),
    )
    follows = numbered.select("_at", "_row").join(before, "_at").select("_row", "_before", "_quarter")
    starts = rows.join(follows, "_row").select(
        F.col("_before").alias("_row"), F.expr("substring(_text, 1, cast(_quarter as int))").alias("_start")
    )
    # Repeated rows bring the same start.
    starts = starts.groupBy("_row").agg(F.first("_start").alias("_start"))
    # A repeated row only repeats its votes, which changes no majority.
    both = rows.join(starts, "_row")
    stays = F.expr("substring(_text, 1, cast(length(_text) - floor(length(_text) / 4) as int))")
    edited = F.concat(stays, F.col("_start"))
    versions = F.array(
        F.struct(F.lit(0).alias("edit"), F.col("_text").alias("_version"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("edit"), edited.alias("_version"), F.sha2(edited, 256).alias("sha")),
    )
    spread = both.select("_row", F.explode(versions).alias("_v")).select("_row", "_v.edit", "_v.sha", "_v._version")
    hashes = simhash(spread, ["_row", "edit", "sha"], "_version", shingle)
    one = written(
        hashes.groupBy("_row").agg(
            F.max("sha").alias("edited_text_sha256"),
            F.max(F.when(F.col("edit") == 0, F.col("simhash"))).alias("simhash"),
            F.max(F.when(F.col("edit") == 1, F.col("simhash"))).alias("edited_simhash"),
        )
    )
    following = one.join(follows, "_row").select(
        F.col("_before").alias("_row"), F.col("simhash").alias("next_simhash")
    )
    found = one.join(following, "_row").join(numbered.select("_row", "_key", "n_chars", "_times"), "_row")
    repeated = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(
        F.col("_key").alias(key),
        "n_chars",
        "edited_text_sha256",
        "simhash",
        "edited_simhash",
        "next_simhash",
        likeness(F.col("simhash"), F.col("edited_simhash")).alias("likeness_edited"),
        likeness(F.col("simhash"), F.col("next_simhash")).alias("likeness_next"),
    )
