"""Per-medium recommender: training, scoring and the held-out benchmark.

The models of all media and folds are grown together (:mod:`cultiva.plans.boosting`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva import values
from cultiva.operators import metrics as M
from cultiva.operators.encode import label_matrix, label_table
from cultiva.operators.folds import group_folds
from cultiva.operators.ranking import top_media_from_scores
from cultiva.plans import boosting
from cultiva.plans.boosting import Ensemble, Model, Trees
from cultiva.plans.training_table import with_group
from cultiva.session import materialize


def prepare(
    strains: DataFrame,
    links: DataFrame,
    minimum: int = values.MIN_STRAINS_PER_MEDIUM,
    k: int = 5,
    group_mode: str = "whole_species",
    key: str = "bacdive_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(folded strains, positives, media)`` of a leakage-free benchmark.

    ``strains``: key, family, genus, species and anything to carry along. The
    compact results are materialized, so that every metric starts from them
    instead of from the links.
    """
    kept, positives, media = label_table(strains, links, minimum, key)
    grouped = materialize(with_group(strains.join(kept, key, "left_semi"), group_mode))
    return materialize(group_folds(grouped, "group", k)), materialize(positives), media


FOLD_METRICS = (
    "medium_id string, fold int, n_train bigint, n_test bigint, n_test_positives bigint, "
    "roc_auc double, pr_auc double"
)


def benchmark_table(
    strains: DataFrame, positives: DataFrame, features: DataFrame, names: Sequence[str], media: Sequence[str],
    key: str = "bacdive_id",
) -> DataFrame:
    """``key, fold``, the features ``names`` and ``grown``, 0 or 1 for each of ``media``."""
    labels = label_matrix(strains.select(key), positives, media, key)
    grown = labels.select(key, F.array(*[F.col(f"`{m}`") for m in media]).alias("grown"))
    own = features.select(key, *[F.col(f"`{n}`") for n in names])
    return strains.select(key, "fold").join(grown, key).join(own, key)


def _sizes(table: DataFrame, media: Sequence[str], keys: Sequence[str]) -> list:
    """Rows and positives of every medium, per fold or in all."""
    sums = [F.sum(F.get("grown", F.lit(i)).cast("bigint")) for i in range(len(media))]
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("positives")).collect()


def _fold_models(
    table: DataFrame, media: Sequence[str], min_train: int, min_negatives: int, min_test: int
) -> tuple[list[Model], list[tuple]]:
    """Models of the media and folds that can be trained, and ``(chain, place, medium, fold, sizes...)``."""
    sizes = sorted(_sizes(table, media, ["fold"]), key=lambda r: r["fold"])
    total = sum(r["n"] for r in sizes)
    models, described = [], []
    for i, medium in enumerate(media):
        grown = sum(r["positives"][i] for r in sizes)
        for r in sizes:
            n_train, n_test, test_pos = total - r["n"], r["n"], r["positives"][i]
            train_pos = grown - test_pos
            if train_pos < min_train or n_train - train_pos < min_negatives or test_pos < min_test:
                continue
            weight = (n_train - train_pos) / max(1, train_pos)
            chain = len(models)
            models.append(Model(medium, i, "binary", chain, r["fold"], weight=weight))
            described.append((chain, i, medium, r["fold"], n_train, n_test, test_pos))
    return models, described


CHAINS = "chain int, place int, medium_id string, fold int, n_train bigint, n_test bigint, n_test_positives bigint"


def _fit(table, media, features, models, trees, keep) -> boosting.Fit:
    labels = [F.get("grown", F.lit(i)) for i in range(len(media))]
    return boosting.fit(table, features, labels, models, trees, [F.col("fold")], keep)


def train_per_medium(
    table: DataFrame, media: Sequence[str], features: Sequence[str], key: str = "bacdive_id",
    trees: Trees = Trees(iterations=200), min_train: int = 5, min_test: int = 1,
) -> DataFrame:
    """Cross-validated metrics per medium and fold, all models grown in one run.

    ``table`` is that of :func:`benchmark_table`. Folds with too few positives, or with
    one class only, are skipped.
    """
    spark = table.sparkSession
    table = materialize(table)
    models, described = _fold_models(table, media, max(1, min_train), 1, min_test)
    if not models:
        return spark.createDataFrame([], FOLD_METRICS)
    fitted = _fit(table, media, features, models, trees, [key, "grown"])
    chains = spark.createDataFrame(described, CHAINS)
    scored = fitted.held_out([key, "grown"]).drop("fold").join(F.broadcast(chains), "chain").select(
        "medium_id", "fold", F.get("grown", F.col("place")).alias("y"), F.get("scores", F.lit(0)).alias("score")
    )
    keys = ["medium_id", "fold"]
    found = M.auc_from_counts(M.score_counts(scored, keys), keys)
    return chains.join(found, keys).select(*[c.split()[0] for c in FOLD_METRICS.split(", ")])


def train_production(
    table: DataFrame, media: Sequence[str], features: Sequence[str], trees: Trees = Trees(), minimum: int = 10
) -> Ensemble | None:
    """One model per medium on all rows; media short of either class are skipped."""
    table = materialize(table)
    counts = _sizes(table, media, [])[0]
    models = []
    for i, medium in enumerate(media):
        n_pos = counts["positives"][i]
        n_neg = counts["n"] - n_pos
        if n_pos >= minimum and n_neg >= minimum:
            models.append(Model(medium, i, "binary", len(models), weight=n_neg / n_pos))
    return _fit(table, media, features, models, trees, []).ensemble if models else None


def save_models(spark: SparkSession, models: Ensemble, path: str) -> None:
    """A bundle of all media: trees, feature order, bins and names."""
    boosting.save(spark, {"media": models}, path, {"kind": "media"})


def load_models(spark: SparkSession, path: str) -> Ensemble:
    ensembles, described = boosting.load(spark, path)
    if described.get("kind") != "media":
        raise ValueError("not a bundle of media")
    return ensembles["media"]


def score_all_media(genomes: DataFrame, models: Ensemble, key: Sequence[str]) -> DataFrame:
    """Long ``(key, medium_id, score)``; every row makes its own scores, no shuffle."""
    scored = boosting.with_scores(genomes, models)
    entries = [
        F.struct(F.lit(m.name).alias("medium_id"), F.get("_scores", F.lit(i)).alias("score"))
        for i, m in enumerate(models.models)
    ]
    return scored.select(*key, F.inline(F.array(*entries)))


def top_media(
    genomes: DataFrame, models: Ensemble, names: dict[str, str], key: str = "genome_accession", k: int = 3
) -> DataFrame:
    """Best ``k`` media per genome as columns, without a shuffle."""
    scored = boosting.with_scores(genomes, models)
    columns = {m.name: f"_score_{i}" for i, m in enumerate(models.models)}
    wide = scored.select(key, *[F.get("_scores", F.lit(i)).alias(c) for i, c in enumerate(columns.values())])
    return wide.select(key, *top_media_from_scores(columns, names, k))


def fold_scores(
    table: DataFrame, media: Sequence[str], features: Sequence[str], key: str = "bacdive_id",
    trees: Trees = Trees(iterations=200), minimum: int = 5,
) -> DataFrame:
    """Held-out ``(key, fold, medium_id, y, score)``, all models grown in one run.

    The score is the training prevalence where a fold has fewer than
    ``minimum`` positives or negatives to train on.
    """
    spark = table.sparkSession
    table = materialize(table)
    models, described = _fold_models(table, media, minimum, minimum, 0)
    sizes = _sizes(table, media, ["fold"])
    total = sum(r["n"] for r in sizes)
    trained = {(d[1], d[3]) for d in described}
    defaults = [
        (i, m, r["fold"], (sum(s["positives"][i] for s in sizes) - r["positives"][i]) / max(1, total - r["n"]))
        for i, m in enumerate(media) for r in sizes if (i, r["fold"]) not in trained
    ]
    chosen = spark.createDataFrame(defaults, "place int, medium_id string, fold int, score double")
    columns = [key, "fold", "medium_id", F.get("grown", F.col("place")).alias("y"), "score"]
    rest = table.select(key, "fold", "grown").join(F.broadcast(chosen), "fold").select(*columns)
    if not models:
        return rest
    fitted = _fit(table, media, features, models, trees, [key, "grown"])
    chains = spark.createDataFrame(described, CHAINS).select("chain", "place", "medium_id")
    scored = fitted.held_out([key, "grown"]).join(F.broadcast(chains), "chain")
    return scored.withColumn("score", F.get("scores", F.lit(0))).select(*columns).unionByName(rest)


def popularity_benchmark(
    strains: DataFrame, positives: DataFrame, ks: Sequence[int] = (1, 3, 5), key: str = "bacdive_id"
) -> DataFrame:
    """Top-k metrics of ranking media by training popularity.

    Ranks are made once per fold and medium and then joined to the true media, so
    the strains-by-media score matrix is never built.
    """
    scores = M.popularity_scores(strains.select(key, "fold"), positives, key)
    ranks = M.rank_scores(scores, ["fold"])
    ranked = positives.join(strains.select(key, "fold"), key).join(ranks, ["fold", "medium_id"])
    return M.topk_metrics(ranked, [key], ks)


def taxonomy_benchmark(
    strains: DataFrame, positives: DataFrame, media: DataFrame, ks: Sequence[int] = (1, 3, 5),
    minimum: int = 3, key: str = "bacdive_id",
) -> DataFrame:
    """Top-k metrics of ranking ``media`` by popularity within genus, family or all."""
    used, scores = M.taxonomy_scores(strains, positives, minimum, key)
    wanted = positives.join(used, key)
    ranked = M.sparse_ranks(wanted, scores, media, ["fold", "level", "taxon"])
    return M.topk_metrics(ranked, [key], ks)


def model_benchmark(scores: DataFrame, ks: Sequence[int] = (1, 3, 5), key: str = "bacdive_id") -> DataFrame:
    """Top-k metrics of held-out model scores."""
    ranked = M.rank_scores(scores, [key]).filter(F.col("y") == 1)
    return M.topk_metrics(ranked, [key], ks)


def popularity_auc(strains: DataFrame, positives: DataFrame, key: str = "bacdive_id") -> DataFrame:
    """Per-medium ROC-AUC and PR-AUC of popularity scores.

    All strains of a fold share a medium's score, so class counts per fold are
    enough.
    """
    scores = M.popularity_scores(strains.select(key, "fold"), positives, key)
    sizes = strains.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    grown = positives.join(strains.select(key, "fold"), key).groupBy("fold", "medium_id").agg(
        F.count(F.lit(1)).alias("_pos")
    )
    counts = (
        scores.join(sizes, "fold")
        .join(grown, ["fold", "medium_id"], "left")
        .groupBy("medium_id", "score")
        .agg(
            F.sum(F.coalesce("_pos", F.lit(0))).alias("n_pos"),
            F.sum(F.col("_n") - F.coalesce("_pos", F.lit(0))).alias("n_neg"),
        )
    )
    return M.auc_from_counts(counts, ["medium_id"])


def heldout_manifest(
    strains: DataFrame, positives: DataFrame, phenotypes: DataFrame, names: DataFrame,
    key: str = "bacdive_id",
) -> DataFrame:
    """Fold, labels and true media of every strain; lists are bounded by the media."""
    named = positives.join(names.select("medium_id", F.col("name").alias("_name")), "medium_id", "left")
    true = named.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("medium_id", F.coalesce("_name", F.lit("")).alias("name")))
        ).alias("_media")
    )
    def text(column: str) -> F.Column:
        return F.coalesce(column, F.lit("")).alias(column)

    return (
        strains.select(key, "fold")
        .join(phenotypes, key, "left")
        .join(true, key, "left")
        .select(
            key,
            "fold",
            "genome_accession",
            text("species"),
            text("genus"),
            text("family"),
            F.col("optimal_temperature_c"),
            F.col("optimal_ph"),
            F.col("salt_tolerance_pct"),
            text("oxygen_requirement"),
            F.coalesce(F.array_join("_media.medium_id", "|"), F.lit("")).alias("true_media_ids"),
            F.coalesce(F.array_join("_media.name", "|"), F.lit("")).alias("true_media_names"),
            F.coalesce(F.size("_media"), F.lit(0)).alias("n_true_media"),
        )
    )
