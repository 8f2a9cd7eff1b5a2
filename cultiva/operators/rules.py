"""Pathway module rules as a node table, and completeness as joins and aggregates.

A rule is read as a conjunction of steps; commas join single alternatives. Every
bracket is a conjunction whose children are alternatives chains, every chain has
leaves (profiles) or brackets as members::

    AND(root) -> chain -> leaf | bracket(AND) -> chain -> ...

Scores are computed for hits only: whatever has no row scores zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cultiva.session import materialize

TOKEN = r"(K\d{5}|[()+,-]|\s+)"
EMPTY = "E"  # an alternative that can never be met
ROOT = 0


def _tokens(definition: Column) -> Column:
    known = F.array_join(F.regexp_extract_all(definition, F.lit(TOKEN), F.lit(1)), "")
    tidy = F.trim(F.regexp_replace(known, r"\s+", " "))
    return F.regexp_extract_all(tidy, F.lit(TOKEN), F.lit(1))


def _resolved(tokens: Column) -> Column:
    """Tokens in which every comma joins two members.

    Directly after a joining comma anything but a profile or an opening bracket
    is an empty member, and so is a comma that follows no member.
    """

    def step(state: Column, token: Column) -> Column:
        opens, profile = token == "(", token.startswith("K")
        joins = (token == ",") & (state["last"] == "member")
        empty = ((state["last"] == "comma") & ~opens & ~profile) | ((token == ",") & ~joins)
        glue = token.isin(" ", "+", "-")
        shown = F.when(empty, EMPTY).when(glue, " ").otherwise(token)
        last = (
            F.when(empty | profile | (token == ")"), "member").when(joins, "comma").otherwise("none")
        )
        return F.struct(
            last.alias("last"), F.concat(state["seen"], F.array(shown)).alias("seen")
        )

    start = F.struct(
        F.lit("none").alias("last"), F.expr("cast(array() as array<string>)").alias("seen")
    )
    return F.aggregate(tokens, start, step, lambda s: s["seen"])


def _levelled(modules: DataFrame, module: str) -> DataFrame:
    """Tokens with the bracket depth they stand in; cut at a stray closing bracket."""
    tokens = modules.select(
        module,
        F.posexplode(_resolved(_tokens(F.coalesce("definition", F.lit(""))))).alias("_pos", "token"),
    ).withColumn("_pos", F.col("_pos") + 1)
    order = W.partitionBy(module).orderBy("_pos")
    change = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    depth = tokens.withColumn("_after", F.sum(change).over(order))
    kept = depth.withColumn("_lowest", F.min("_after").over(order)).filter(F.col("_lowest") >= 0)
    # depth after the last token: brackets that were never closed
    return kept.withColumn("_open", F.sum(change).over(W.partitionBy(module)))


def rejected_rules(modules: DataFrame, module: str = "id") -> DataFrame:
    """Modules whose rule leaves a bracket open; they get no nodes."""
    return _levelled(modules, module).filter(F.col("_open") > 0).select(module).distinct()


def rule_nodes(modules: DataFrame, module: str = "id") -> DataFrame:
    """Members of all rules.

    Columns: module, node, kind (``leaf`` or ``and``), ko, depth, parent (the
    enclosing ``and`` node), chain (alternatives share one), n_children (chains
    of an ``and`` node). The root of a rule is node 0 with no parent.
    """
    tokens = _levelled(modules, module).filter(F.col("_open") == 0)
    order = W.partitionBy(module).orderBy("_pos")
    level = F.when(F.col("token") == "(", F.col("_after") - 1).otherwise(F.col("_after"))
    member = F.col("token").isin("(", EMPTY) | F.col("token").startswith("K")
    placed = (
        tokens.withColumns({"depth": level, "_previous": F.lag("token").over(order)})
        .filter(member)
        .select(module, "_pos", "token", "_previous", "depth")
    )
    # An opening bracket is a member of its own depth and the parent one deeper.
    as_member = F.struct("depth", "token", F.lit(None).cast("int").alias("_opener"))
    as_parent = F.struct(
        (F.col("depth") + 1).alias("depth"),
        F.lit(None).cast("string").alias("token"),
        F.col("_pos").alias("_opener"),
    )
    roles = F.when(F.col("token") == "(", F.array(as_member, as_parent)).otherwise(F.array(as_member))
    inside = W.partitionBy(module, "depth").orderBy("_pos")
    opener = F.coalesce(F.last("_opener", ignorenulls=True).over(inside), F.lit(ROOT))
    with_parent = (
        placed.select(module, "_pos", "_previous", F.inline(roles))
        .withColumn("parent", opener)
        .filter(F.col("token").isNotNull())
    )
    siblings = W.partitionBy(module, "parent").orderBy("_pos")
    starts = F.when(F.coalesce(F.col("_previous"), F.lit("")) == ",", 0).otherwise(1)
    members = materialize(with_parent.withColumn("chain", F.sum(starts).over(siblings)))
    sizes = members.groupBy(module, F.col("parent").alias("node")).agg(
        F.max("chain").alias("n_children")
    )
    below = members.select(
        module,
        F.col("_pos").alias("node"),
        F.when(F.col("token") == "(", "and").otherwise("leaf").alias("kind"),
        F.when(F.col("token").startswith("K"), F.col("token")).alias("ko"),
        "depth",
        "parent",
        "chain",
    ).join(sizes, [module, "node"], "left")
    roots = sizes.filter(F.col("node") == ROOT).select(
        module,
        "node",
        F.lit("and").alias("kind"),
        F.lit(-1).cast("bigint").alias("depth"),
        "n_children",
    )
    nodes = below.unionByName(roots, allowMissingColumns=True)
    return nodes.withColumnRenamed(module, "module").select(
        "module", "node", "kind", "ko", "depth", "parent", "chain",
        F.when(F.col("kind") == "and", F.coalesce("n_children", F.lit(0))).alias("n_children"),
    )


def module_completeness(
    hits: DataFrame,
    nodes: DataFrame,
    fractional: bool = True,
    genome: str = "genome_accession",
    hit: str = "ko",
) -> DataFrame:
    """``(genome, module, completeness)`` of modules that score above zero.

    ``fractional`` gives a step chain the mean of its steps, otherwise the
    minimum. Met leaves are partitioned by genome and module once; no aggregate
    after that moves rows again.
    """
    nodes = materialize(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0]
    leaves = nodes.filter(F.col("kind") == "leaf").select("module", "ko", "depth", "parent", "chain")
    brackets = nodes.filter(F.col("kind") == "and").select(
        "module",
        F.col("node").alias("_node"),
        "n_children",
        F.col("depth").alias("_depth"),
        F.col("parent").alias("_parent"),
        F.col("chain").alias("_chain"),
    )
    # The distinct hits are the only large input and every depth reads them, so
    # they are written out once; each leaf belongs to one depth.
    held = materialize(
        hits.select(F.col(genome).alias("_genome"), F.col(hit).alias("ko")).distinct()
    )
    met = (
        held.join(leaves, "ko")
        .select("_genome", "module", "depth", "parent", "chain", F.lit(1.0).alias("score"))
        .repartition("_genome", "module")
    )
    keys = ["_genome", "module"]
    above = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = met.filter(F.col("depth") == depth).drop("depth")
        if above is not None:
            here = here.unionByName(
                above.select(*keys, "parent", "chain", "score")
            )
        chains = here.groupBy(*keys, "parent", "chain").agg(F.max("score").alias("score"))
        steps = chains.groupBy(*keys, "parent").agg(
            F.sum("score").alias("_sum"), F.min("score").alias("_min"), F.count(F.lit(1)).alias("_met")
        )
        closed = steps.withColumnRenamed("parent", "_node").join(brackets, ["module", "_node"])
        score = (
            F.col("_sum") / F.col("n_children")
            if fractional
            else F.when(F.col("_met") == F.col("n_children"), F.col("_min")).otherwise(0.0)
        )
        above = closed.select(
            *keys,
            F.col("_parent").alias("parent"),
            F.col("_chain").alias("chain"),
            F.col("_node"),
            score.alias("score"),
        ).filter(F.col("score") > 0)
    if above is None:
        return met.select(
            F.col("_genome").alias(genome), "module", F.col("score").alias("completeness")
        ).limit(0)
    return above.filter(F.col("_node") == ROOT).select(
        F.col("_genome").alias(genome), "module", F.col("score").alias("completeness")
    )


def module_matrix(
    genomes: DataFrame,
    completeness: DataFrame,
    modules: Sequence[str],
    genome: str = "genome_accession",
) -> DataFrame:
    """``kegg_<module>`` columns, one row per genome, zero where nothing was met."""
    wide = completeness.groupBy(genome).pivot("module", list(modules)).agg(F.first("completeness"))
    filled = genomes.select(genome).distinct().join(wide, genome, "left")
    return filled.select(
        genome, *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(f"kegg_{m}") for m in modules]
    )


def hit_sets(records: DataFrame) -> DataFrame:
    """``(genome_accession, ko)`` from hit records; the first record of a genome counts.

    Records carry ``genome_accession`` or ``accession``, ``ko_hits`` and their
    position ``line``.
    """
    columns = [F.col(c) for c in ("genome_accession", "accession") if c in records.columns]
    named = records.select(
        F.coalesce(*[F.when(c != "", c) for c in columns]).alias("genome_accession"),
        "line",
        "ko_hits",
    ).filter(F.col("genome_accession").isNotNull())
    first = named.groupBy("genome_accession").agg(F.min_by("ko_hits", "line").alias("ko_hits"))
    return first.select("genome_accession", F.explode("ko_hits").alias("ko")).distinct()
