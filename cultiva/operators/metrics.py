"""Ranking, classification, regression and comparison metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import present
from cultiva.operators.ordered import prefix_sums, row_index
from cultiva.operators.ranking import page

# --- ranking ----------------------------------------------------------------


def score_counts(scores: DataFrame, keys: Sequence[str], label: str = "y", score: str = "score") -> DataFrame:
    """``(keys, score, n_pos, n_neg)``: all a threshold metric needs to know.

    Rows without a label or with a score that is no number are left out.
    """
    known = F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return scores.filter(known).groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def auc_from_counts(counts: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Area under the ROC curve and average precision per key.

    Equal scores form one threshold. Keys with a single class are left out.
    """
    keys = list(keys)
    ordered = prefix_sums(counts, keys, [score], ["n_pos", "n_neg"], descending=True)
    tp, fp = F.col("n_pos_before") + F.col("n_pos"), F.col("n_neg_before") + F.col("n_neg")
    # Positives above each negative, ties counted half.
    won = F.col("n_neg") * (F.col("n_pos_before") + F.col("n_pos") / 2)
    sums = ordered.groupBy(*keys).agg(
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_neg").alias("n_neg"),
        F.sum(F.try_divide(F.col("n_pos") * tp, tp + fp)).alias("_precision"),
        F.sum(won).alias("_won"),
    )
    return sums.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).select(
        *keys,
        "n_pos",
        "n_neg",
        (F.col("_precision") / F.col("n_pos")).alias("pr_auc"),
        (F.col("_won") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
    )


def per_medium_auc(scores: DataFrame, medium: str = "medium_id") -> DataFrame:
    return auc_from_counts(score_counts(scores, [medium]), [medium])


def rank_scores(scores: DataFrame, row: Sequence[str], medium: str = "medium_id") -> DataFrame:
    """Rank of every medium per row, best first, ties by medium id.

    A row has at most one entry per medium, so the window is bounded.
    """
    order = W.partitionBy(*row).orderBy(F.col("score").desc(), medium)
    return scores.withColumn("rank", F.row_number().over(order))


def topk_metrics(positives: DataFrame, row: Sequence[str], ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = ()) -> DataFrame:
    """MRR, hit, recall and precision at k from the ranks of the true media.

    ``positives`` has one line per row and true medium with its ``rank``; rows
    without a true medium do not count, so they need not be there.
    """
    per_row = positives.groupBy(*by, *row).agg(
        F.count(F.lit(1)).alias("_true"),
        F.min("rank").alias("_best"),
        *[F.count_if(F.col("rank") <= k).alias(f"_top{k}") for k in ks],
    )
    return per_row.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.avg("_true").alias("mean_true_media"),
        F.avg(1 / F.col("_best")).alias("mrr"),
        *[
            metric
            for k in ks
            for metric in (
                F.avg((F.col("_best") <= k).cast("double")).alias(f"hit_at_{k}"),
                F.avg(F.col(f"_top{k}") / F.col("_true")).alias(f"recall_at_{k}"),
                (F.avg(f"_top{k}") / k).alias(f"precision_at_{k}"),
            )
        ],
    )


def popularity_scores(strains: DataFrame, positives: DataFrame, key: str = "bacdive_id") -> DataFrame:
    """Share of a fold's training strains that grow on each medium.

    ``strains``: key, fold. Result: fold, medium_id, score. Training counts are
    totals minus the fold's own counts, so nothing is copied per fold. Where all
    strains are in one fold, it has no training strains and every score is 0.
    """
    sizes = strains.groupBy("fold").agg(F.count(F.lit(1)).alias("_fold_n"))
    grown = positives.join(strains, key).groupBy("fold", "medium_id").agg(
        F.count(F.lit(1)).alias("_fold_pos")
    )
    totals = grown.groupBy("medium_id").agg(
        F.sum("_fold_pos").alias("_pos"), F.lit(1).alias("_one")
    )
    n = sizes.agg(F.sum("_fold_n")).scalar()
    # folds (at most a handful) times media
    folds = sizes.agg(F.collect_list(F.struct("fold", "_fold_n"))).scalar()
    grid = totals.select("medium_id", "_pos", F.inline(folds)).withColumn("_n", n)
    joined = grid.join(grown, ["fold", "medium_id"], "left")
    return joined.select(
        "fold",
        "medium_id",
        F.coalesce(
            F.try_divide(
                F.col("_pos") - F.coalesce("_fold_pos", F.lit(0)), F.col("_n") - F.col("_fold_n")
            ),
            F.lit(0.0),
        ).alias("score"),
    )


def _taxon_scores(strains: DataFrame, positives: DataFrame, level: str, minimum: int, key: str) -> DataFrame:
    """``(fold, level name, taxon, medium_id, score)`` of taxa with enough training strains."""
    named = strains.filter(F.col(level).isNotNull() & (F.col(level) != ""))
    sizes = named.groupBy(level, "fold").agg(F.count(F.lit(1)).alias("_fold_n"))
    of_taxon = W.partitionBy(level)
    trained = sizes.withColumn("_n", F.sum("_fold_n").over(of_taxon) - F.col("_fold_n")).filter(
        F.col("_n") >= minimum
    )
    grown = positives.join(named.select(key, level, "fold"), key).groupBy(level, "medium_id", "fold").agg(
        F.count(F.lit(1)).alias("_fold_pos")
    )
    totals = grown.groupBy(level, "medium_id").agg(F.sum("_fold_pos").alias("_pos"))
    here = trained.join(totals, level).join(grown, [level, "medium_id", "fold"], "left")
    return here.select(
        "fold",
        F.col(level).alias("taxon"),
        "medium_id",
        ((F.col("_pos") - F.coalesce("_fold_pos", F.lit(0))) / F.col("_n")).alias("score"),
    ).filter(F.col("score") > 0), trained.select("fold", F.col(level).alias("taxon"))


def taxonomy_scores(
    strains: DataFrame,
    positives: DataFrame,
    minimum: int = 3,
    key: str = "bacdive_id",
) -> tuple[DataFrame, DataFrame]:
    """Genus, else family, else global popularity.

    ``strains``: key, fold, genus, family. Returns the level and taxon used for
    every strain, and ``(fold, level, taxon, medium_id, score)`` of the taxa in use and
    the media with a score above 0; all others have the score 0. Strains of one
    taxon share their scores, so no strains-by-media table is built.
    """
    genus_scores, genus_ok = _taxon_scores(strains, positives, "genus", minimum, key)
    family_scores, family_ok = _taxon_scores(strains, positives, "family", minimum, key)
    g = genus_ok.select("fold", F.col("taxon").alias("genus"), F.lit(True).alias("_g"))
    f = family_ok.select("fold", F.col("taxon").alias("family"), F.lit(True).alias("_f"))
    used = (
        strains.join(g, ["fold", "genus"], "left")
        .join(f, ["fold", "family"], "left")
        .select(
            key,
            "fold",
            F.when(F.col("_g"), "genus").when(F.col("_f"), "family").otherwise("global").alias("level"),
            F.when(F.col("_g"), F.col("genus")).when(F.col("_f"), F.col("family")).otherwise("").alias("taxon"),
        )
    )
    found = (
        genus_scores.withColumn("level", F.lit("genus"))
        .unionByName(family_scores.withColumn("level", F.lit("family")))
        .unionByName(
            popularity_scores(strains.select(key, "fold"), positives, key).select(
                "fold", F.lit("").alias("taxon"), "medium_id", "score", F.lit("global").alias("level")
            )
        )
    )
    taxa = used.select("fold", "level", "taxon").distinct()
    scores = found.filter("score > 0").join(taxa, ["fold", "level", "taxon"], "left_semi")
    return used, scores


def every_medium(used: DataFrame, scores: DataFrame, media: DataFrame, medium: str = "medium_id") -> DataFrame:
    """Scores of every taxon in use and each of ``media``: those :func:`taxonomy_scores` does not list are 0."""
    row = ["fold", "level", "taxon"]
    grid = used.select(*row).distinct().crossJoin(F.broadcast(media.select(medium).distinct()))
    return grid.join(scores, [*row, medium], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def sparse_ranks(
    wanted: DataFrame, scores: DataFrame, media: DataFrame, row: Sequence[str], medium: str = "medium_id"
) -> DataFrame:
    """Add ``rank`` to ``wanted`` (``row`` and ``medium``), where only scores above 0 are listed.

    Ranks go by falling score, equal ones by medium id, over all ``media``. A medium
    without a score comes after the ones with a score, at its place by id among the
    media without one: its place among all, less those before it that have a score. The
    windows hold the media of one row, so they are bounded by the media.
    """
    row = list(row)
    ranked = rank_scores(scores, row, medium)
    numbered = row_index(media.select(medium).distinct(), [medium], into="_place")
    listed = scores.select(*row, medium, F.lit(1).alias("_above")).unionByName(
        wanted.select(*row, medium).distinct().withColumn("_above", F.lit(0))
    )
    counted = listed.groupBy(*row, medium).agg(F.max("_above").alias("_above"), F.count(F.lit(1)).alias("_n"))
    of_row = W.partitionBy(*row)
    before = of_row.orderBy(medium).rowsBetween(W.unboundedPreceding, -1)
    missing = counted.withColumns(
        {"_all": F.sum("_above").over(of_row), "_before": F.coalesce(F.sum("_above").over(before), F.lit(0))}
    ).filter("_above = 0").join(numbered, medium)
    last = missing.select(
        *row, medium, (F.col("_all") + F.col("_place") - F.col("_before") + 1).cast("int").alias("rank")
    )
    return wanted.join(ranked.select(*row, medium, "rank").unionByName(last), [*row, medium])


# --- regression -------------------------------------------------------------


def mean_absolute_error(predicted: Column, observed: Column) -> Column:
    return F.avg(F.abs(predicted - observed))


def constant_mean_mae(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Error of always predicting the mean."""
    known = df.filter(present(df, target))
    if not keys:
        centred = known.withColumn("_mean", known.agg(F.avg(target)).scalar())
    else:
        means = known.groupBy(*keys).agg(F.avg(target).alias("_mean"))
        centred = known.join(means, list(keys))
    return centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mean_absolute_error(F.col(target), F.col("_mean")).alias("mae")
    )


# --- classification ---------------------------------------------------------


def confusion_counts(df: DataFrame, true: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(true).alias("true_class"), F.col(predicted).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_scores(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 for every true or predicted class."""
    same = F.col("true_class") == F.col("pred_class")
    parts = F.array(
        F.struct(
            F.col("true_class").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(same, F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("pred_class").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("tp"),
        ),
    )
    counted = confusion.select(*keys, F.inline(parts)).groupBy(*keys, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    return with_f1(counted)


def with_f1(counted: DataFrame) -> DataFrame:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp = F.col("tp")
    scored = counted.withColumns(
        {"precision": ratio(tp, F.col("predicted")), "recall": ratio(tp, F.col("support"))}
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))


def macro_f1(df: DataFrame, true: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean F1 over the classes that occur as true or predicted."""
    scored = class_scores(confusion_counts(df, true, predicted, keys), keys)
    return scored.groupBy(*keys).agg(F.sum("support").alias("n"), F.avg("f1").alias("f1_macro"))


def majority_f1(df: DataFrame, label: str) -> DataFrame:
    """Macro F1 of always predicting the most frequent (then smallest) label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    majority = counts.agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label)))).scalar()
    predicted = counts.select(F.col(label).alias("true_class"), majority.alias("pred_class"), "n")
    scored = class_scores(predicted)
    return scored.agg(F.sum("support").alias("n"), F.avg("f1").alias("f1_macro"))


def class_report(confusion: DataFrame, classes: Sequence[str], digits: int = 6) -> DataFrame:
    """Scores and confusion row for every class of a fixed list, used or not."""
    listed = confusion.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(classes)], "class_index int, class string"
    )
    scored = class_scores(confusion)
    rows = confusion.groupBy(F.col("true_class").alias("class")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("pred_class") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}")
            for c in classes
        ]
    )
    joined = listed.join(scored, "class", "left").join(rows, "class", "left")
    numbers = [c for c in joined.columns if c not in ("class", "class_index")]
    filled = joined.fillna(0, subset=numbers)
    return filled.select(
        "class_index",
        "class",
        *[F.bround(c, digits).alias(c) for c in ("precision", "recall", "f1")],
        "support",
        "predicted",
        *[f"pred_{c}" for c in classes],
    )


def class_summary(confusion: DataFrame, classes: Sequence[str], digits: int = 6) -> DataFrame:
    """Accuracy, macro F1 over supported classes and over all classes."""
    scored = class_scores(confusion).filter(F.col("class").isin(*classes))
    return scored.agg(
        F.sum("support").alias("n"),
        F.bround(F.coalesce(F.sum("tp") / F.sum("support"), F.lit(0.0)), digits).alias("accuracy"),
        F.bround(
            F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), digits
        ).alias("macro_f1"),
        F.bround(F.coalesce(F.sum("f1") / len(classes), F.lit(0.0)), digits).alias(
            "macro_f1_all_classes"
        ),
    )


# --- masked multi-task evaluation -------------------------------------------


def masked_loss(
    predictions: DataFrame,
    numeric: Sequence[str] = values.REGRESSION_TARGETS,
    logits: str = "logits",
    class_label: str = "label_oxygen_requirement",
    class_mask: str = "mask_oxygen_requirement",
    target_weights: dict[str, float] | None = None,
    class_weights: Sequence[float] | None = None,
) -> DataFrame:
    """Masked squared error per numeric target, masked cross-entropy and their weighted sum.

    The cross-entropy is divided by the number of unmasked rows, not by the sum
    of their class weights.
    """
    terms = {}
    for target in numeric:
        mask = F.col(f"mask_{target}")
        error = F.pow(F.col(f"pred_{target}") - F.col(f"label_{target}"), 2)
        terms[target] = F.sum(F.when(mask == 1, error).otherwise(0.0)) / F.greatest(F.sum(mask), F.lit(1))
    z = F.col(logits)
    top = F.array_max(z)
    log_total = top + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    entropy = log_total - F.get(z, F.col(class_label))
    if class_weights is not None:
        entropy = entropy * F.get(F.array(*[F.lit(float(w)) for w in class_weights]), F.col(class_label))
    mask = F.col(class_mask)
    terms["oxygen"] = F.sum(F.when(mask == 1, entropy).otherwise(0.0)) / F.greatest(F.sum(mask), F.lit(1))
    losses = predictions.agg(*[t.alias(f"loss_{name}") for name, t in terms.items()])
    weights = target_weights or {}
    weighted = [F.col(f"loss_{name}") * float(weights.get(name, 1.0)) for name in terms]
    return losses.withColumn("loss", reduce(lambda a, b: a + b, weighted))


def masked_validation(
    predictions: DataFrame,
    numeric: Sequence[str] = values.REGRESSION_TARGETS,
    oxygen: str = "oxygen_requirement",
) -> DataFrame:
    """``(target, metric, value, n)`` over unmasked rows; no value without rows."""
    wide = predictions.agg(
        *[
            F.avg(
                F.when(F.col(f"mask_{t}") == 1, F.abs(F.col(f"pred_{t}") - F.col(f"label_{t}")))
            ).alias(f"v_{t}")
            for t in numeric
        ],
        *[F.sum(f"mask_{t}").alias(f"n_{t}") for t in numeric],
    )
    errors = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(t).alias("target"),
                        F.lit("mae").alias("metric"),
                        F.col(f"v_{t}").alias("value"),
                        F.coalesce(f"n_{t}", F.lit(0)).cast("bigint").alias("n"),
                    )
                    for t in numeric
                ]
            )
        )
    )
    shown = predictions.filter(F.col(f"mask_{oxygen}") == 1)
    f1 = macro_f1(shown, f"label_{oxygen}", f"pred_{oxygen}").select(
        F.lit(oxygen).alias("target"),
        F.lit("f1_macro").alias("metric"),
        F.col("f1_macro").alias("value"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    return errors.unionByName(f1)


# --- exploration ------------------------------------------------------------


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep, feature, x)`` with missing values left out."""
    long = df.select(*keep, *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features])
    return long.unpivot(list(keep), list(features), "feature", "x").filter(F.col("x").isNotNull())


def _normal_tail(z: Column) -> Column:
    """Two-sided normal tail; Chebyshev fit of erfc with relative error under 1.2e-7."""
    # Coefficients of the published fit, highest power first
    fit = (
        0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
        -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
    )
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(fit[0])
    for c in fit[1:]:
        poly = poly * t + c
    return F.least(t * F.exp(-x * x + poly), F.lit(1.0))


def _same_rows(table: DataFrame, n: int) -> list[int]:
    """For each of the columns ``x0 ..`` the first one that has values in the same rows.

    Sets of rows are told apart by their size and four sums of row hashes, from one pass.
    """
    row = [F.xxhash64(*table.columns, F.lit(seed)) % (1 << 24) for seed in range(4)]
    present_ = [F.col(f"x{i}").isNotNull() for i in range(n)]
    marks = table.agg(
        *[
            F.struct(F.count_if(p), *[F.coalesce(F.sum(F.when(p, h)), F.lit(0)) for h in row]).alias(f"m{i}")
            for i, p in enumerate(present_)
        ]
    ).first()
    found: dict[tuple, int] = {}
    return [found.setdefault(tuple(marks[f"m{i}"]), i) for i in range(n)]


def spearman(
    df: DataFrame, features: Sequence[str], target: str, top_n: int | None = 15, minimum: int = 30
) -> DataFrame:
    """Rank correlation of every feature with the target over complete pairs.

    Features need ``minimum`` pairs and some variation. ``p_value`` is the normal
    approximation of rho times the square root of n - 1.
    """
    if target not in df.columns:
        return df.sparkSession.createDataFrame([], "feature string, n bigint, spearman_rho double, p_value double")
    labelled = df.filter(present(df, target)).select(
        F.col(target).cast("double").alias("y"),
        *[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)],
    )
    leader = _same_rows(labelled, len(features))
    # The target is ranked once per set of rows, all sets in one sorted pass over its values.
    sets = sorted(set(leader))
    counts = labelled.groupBy("y").agg(*[F.count_if(F.col(f"x{i}").isNotNull()).alias(f"n{i}") for i in sets])
    ordered = prefix_sums(counts, [], ["y"], [f"n{i}" for i in sets])
    of_y = ordered.select("y", *[(F.col(f"n{i}_before") + (F.col(f"n{i}") + 1) / 2).alias(f"r{i}") for i in sets])
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("x"), F.col(f"r{leader[i]}").alias("ry"))
            for i, f in enumerate(features)
        ]
    )
    pairs = labelled.join(of_y, "y").select(F.inline(entries)).filter(F.col("x").isNotNull())
    # Rows of one value share its rank, so their sums are enough.
    ry = F.col("ry")
    by_value = pairs.groupBy("feature", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ry).alias("sy"), F.sum(ry * ry).alias("syy")
    )
    ranked = prefix_sums(by_value, ["feature"], ["x"], ["n"])
    rx = F.col("n_before") + (F.col("n") + 1) / 2
    # Ranks average (n + 1) / 2, so plain sums are enough and one pass does it.
    sums = ranked.groupBy("feature").agg(
        F.sum(rx * F.col("n")).alias("sx"),
        F.sum("sy").alias("sy"),
        F.sum(rx * rx * F.col("n")).alias("sxx"),
        F.sum("syy").alias("syy"),
        F.sum(rx * F.col("sy")).alias("sxy"),
        F.sum("n").alias("n"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx = F.col("sxx") - sx * sx / n
    vy = F.col("syy") - sy * sy / n
    rho = (F.col("sxy") - sx * sy / n) / F.sqrt(vx * vy)
    result = sums.filter((n >= minimum) & (vx > 0) & (vy > 0)).select(
        "feature", "n", F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0)).alias("spearman_rho")
    )
    result = result.withColumn("p_value", _normal_tail(F.col("spearman_rho") * F.sqrt(F.col("n") - 1)))
    if top_n is None:
        return result
    return page(result, [F.abs("spearman_rho").desc(), "feature"], top_n)


def class_separation(
    df: DataFrame, features: Sequence[str], target: str, top_n: int = 5, minimum: int = 30
) -> DataFrame:
    """Variance of class means over total variance, with the class means.

    One row per feature and class for the ``top_n`` best features.
    """
    long = unpivot(df.filter(F.col(target).isNotNull()), features, [target])
    by_class = long.groupBy("feature", F.col(target).alias("class")).agg(F.avg("x").alias("mean"))
    totals = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("within"))
    between = by_class.groupBy("feature").agg(
        F.var_samp("mean").alias("between"), F.count(F.lit(1)).alias("n_classes")
    )
    scored = (
        totals.join(between, "feature")
        .filter((F.col("n") >= minimum) & (F.col("n_classes") >= 2) & (F.col("within") > 0))
        .select("feature", (F.col("between") / F.col("within")).alias("score"))
    )
    best = page(scored, [F.col("score").desc(), "feature"], top_n)
    return best.join(by_class, "feature")


# --- comparison -------------------------------------------------------------


def _better(delta: Column, higher_is_better: Column) -> Column:
    return F.when(higher_is_better, delta > 0).otherwise(delta < 0)


def compare_runs(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("target", "task")) -> DataFrame:
    """Change from ``first`` to ``second`` metric with its verdict.

    Metrics are in ``value``; classification counts higher as better. Relative
    changes of classification divide by at least 0.001.
    """
    joined = first.select(*keys, F.col("value").alias("value_a")).join(
        second.select(*keys, F.col("value").alias("value_b")), list(keys)
    )
    a, b = F.col("value_a"), F.col("value_b")
    delta = b - a
    classes = F.col("task") == "classification"
    base = F.when(classes, F.greatest(a, F.lit(0.001))).otherwise(a)
    return joined.select(
        *keys,
        "value_a",
        "value_b",
        delta.alias("delta"),
        F.when(base != 0, 100 * delta / base).alias("delta_pct"),
        F.when(F.abs(delta) < 1e-9, "tie")
        .when(_better(delta, classes), "better")
        .otherwise("worse")
        .alias("verdict"),
    )


def ab_lift(arm_a: DataFrame, arm_b: DataFrame) -> DataFrame:
    """Mean fold metric of two arms, change and whether it helps."""
    keys = ["target", "task"]

    def mean(arm: DataFrame) -> DataFrame:
        return arm.groupBy(*keys).agg(F.avg("value").alias("value"))

    return compare_runs(mean(arm_a), mean(arm_b), keys)


def weak_label_verdict(a: Column, b: Column, margin: float = 0.001) -> Column:
    """HELPS, HURTS or WASH for a change of mean absolute error from ``a`` to ``b``."""
    return F.when(b < a - margin, "HELPS").when(b > a + margin, "HURTS").otherwise("WASH")


def improvement_pct(metric: Column, baseline: Column, task: Column, headline: bool = False) -> Column:
    """Percentage better than the constant baseline, guarded against tiny baselines."""
    classes = task == "classification"
    gain = F.when(classes, metric - baseline).otherwise(baseline - metric)
    if headline:
        base = F.greatest(baseline, F.lit(0.001))
    else:
        base = F.when(classes, F.greatest(baseline, F.lit(0.01))).otherwise(baseline)
    return F.when(base != 0, 100 * gain / base)


def rank_importance(importances: DataFrame, n: int = 20, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Most important features per target."""
    order = W.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def external_summary(results: DataFrame) -> DataFrame:
    """Run counts, error per trait over complete pairs and mean run time."""
    ok = F.col("status") == "ok"

    def mae(true: str, predicted: str) -> Column:
        return F.avg(F.when(ok, F.abs(F.col(true) - F.col(predicted))))

    return results.agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed_or_skipped"),
        mae("true_temperature_c", "external_temperature_c").alias("temperature_mae_c"),
        mae("true_ph", "external_ph").alias("ph_mae"),
        mae("true_salt_pct", "external_salt_pct").alias("salt_mae_pct"),
        F.avg(F.when(ok, F.col("elapsed_s"))).alias("mean_elapsed_s"),
    )


def interval_hit(published: Column, low: Column, high: Column) -> Column:
    """Whether a published value lies in the interval; a missing one does not."""
    return F.coalesce(published.between(low, high), F.lit(False))


def interval_coverage(df: DataFrame, targets: Sequence[str] = values.REGRESSION_TARGETS) -> DataFrame:
    """Share of rows per target whose published value lies in the 80 % interval."""
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.avg(
                interval_hit(
                    F.col(t), F.col(f"pred_{t}_low_80"), F.col(f"pred_{t}_high_80")
                ).cast("double")
            ).alias(f"c_{t}")
            for t in targets
        ],
    )
    rows = [F.struct(F.lit(t).alias("target"), F.col(f"c_{t}").alias("coverage")) for t in targets]
    return wide.select("n", F.inline(F.array(*rows))).select("target", "n", "coverage")


