"""Phenotype models: cross-validation, intervals, stored heads and A/B tests.

All models of a call are grown together (:mod:`cultiva.plans.boosting`): folds,
classes, targets and arms share the jobs. Multi-class targets have one tree per
class and round on softmax gradients. 80 % intervals are quantiles of out-of-fold
residuals within the leaves of one tree that predicts the size of the residual, so
their width differs by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import present
from cultiva.functions.vectors import argmax, class_name
from cultiva.operators.folds import group_folds
from cultiva.operators.metrics import macro_f1, weak_label_verdict
from cultiva.operators.ordered import grouped_quantiles
from cultiva.plans import boosting
from cultiva.plans.boosting import Ensemble, Model, Trees
from cultiva.session import materialize

METRIC = {"regression": "mae", "classification": "f1_macro"}
PREDICTIONS = "target string, task string, fold int, row_id string, predicted string, observed string"
FOLDS = "target string, task string, fold int, metric string, value double, n_train bigint, n_test bigint"
IMPORTANCES = "target string, fold int, feature string, importance double"
# Folds of the parts of a run are told apart by this factor.
FOLDS_PER_PART = 1000
# The tree whose leaves share an interval: levels, and residuals per leaf at least.
SPREAD = Trees(iterations=1, depth=3, step=1.0, l2=1e-6, min_weight=30.0)
VERSION = 1


@dataclass
class Results:
    """Tables of one or more cross-validation runs."""

    predictions: list[DataFrame] = field(default_factory=list)
    folds: list[tuple] = field(default_factory=list)
    importances: list[tuple] = field(default_factory=list)

    def add(self, other: Results) -> None:
        self.predictions += other.predictions
        self.folds += other.folds
        self.importances += other.importances

    def prediction_table(self, like: DataFrame) -> DataFrame:
        if not self.predictions:
            return like.sparkSession.createDataFrame([], PREDICTIONS)
        return reduce(DataFrame.unionByName, self.predictions)

    def fold_table(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.createDataFrame(self.folds, FOLDS)

    def importance_table(self, like: DataFrame) -> DataFrame:
        """Mean importance over folds."""
        rows = like.sparkSession.createDataFrame(self.importances, IMPORTANCES)
        return rows.groupBy("target", "feature").agg(F.avg("importance").alias("importance"))


@dataclass(frozen=True)
class Part:
    """One target (or arm) of a run: its rows in folds, and how many of each kind they are.

    ``sizes``: fold to ``(rows, training rows, test rows)``. ``sums``: fold to the sum of
    the training labels. ``counts``: fold and class to training rows.
    """

    target: str
    task: str
    rows: DataFrame
    sizes: dict[int, tuple[int, int, int]]
    sums: dict[int, float]
    counts: dict[tuple[int, str], int]

    @property
    def classes(self) -> list[str]:
        return sorted({c for _, c in self.counts})

    def trained(self, held_out: int) -> int:
        return sum(n for f, (_, n, _) in self.sizes.items() if f != held_out)

    def mean(self, held_out: int) -> float:
        return sum(s for f, s in self.sums.items() if f != held_out) / max(1, self.trained(held_out))

    def seen(self, held_out: int) -> dict[str, int]:
        found = dict.fromkeys(self.classes, 0)
        for (f, c), n in self.counts.items():
            found[c] += n if f != held_out else 0
        return found


def _part(df, target, task, features, row_id, group, k, train_on=None, test_on=None) -> Part:
    """Labelled rows of one target in group folds, written once for all folds."""

    def chosen(condition: Column | None) -> Column:
        return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))

    labelled = df.filter(present(df, target)).withColumns(
        {"_train": chosen(train_on), "_test": chosen(test_on), group: F.coalesce(group, F.lit("__unknown__"))}
    )
    taken = {"row_id", "observed", "fold", "part", "_train", "_test"} & set(features)
    if taken or target in features:
        raise ValueError(f"features named like internal columns or the target: {sorted(taken) or target}")
    columns = [
        F.col(row_id).cast("string").alias("row_id"),
        F.col(target).cast("string" if task == "classification" else "double").alias("observed"),
        F.col("fold").cast("int").alias("fold"), "_train", "_test", *[F.col(f"`{f}`") for f in features],
    ]
    rows = materialize(group_folds(labelled, group, k).select(*columns))
    classes = ["observed"] if task == "classification" else []
    number = F.lit(0.0) if classes else F.when(F.col("_train"), F.col("observed"))
    counted = rows.groupBy("fold", *classes).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_train").alias("train"), F.count_if("_test").alias("test"),
        F.sum(number).alias("total"),
    ).collect()
    sizes: dict[int, tuple[int, int, int]] = {}
    for r in counted:
        old = sizes.get(r["fold"], (0, 0, 0))
        sizes[r["fold"]] = tuple(a + b for a, b in zip(old, (r["n"], r["train"], r["test"])))
    sums = {} if classes else {r["fold"]: r["total"] or 0.0 for r in counted}
    counts = {(r["fold"], r["observed"]): r["train"] for r in counted if r["train"]} if classes else {}
    return Part(target, task, rows, sizes, sums, counts)


def _models(part: Part, number: int, held_out: int, chain: int) -> list[Model]:
    """The models of one part and fold (-1: no fold is left out)."""
    left_out = number * FOLDS_PER_PART + held_out if held_out >= 0 else -1
    if part.task == "regression":
        return [Model(part.target, number, "squared", chain, left_out, base=part.mean(held_out))]
    seen, total = part.seen(held_out), part.trained(held_out)
    return [
        Model(
            name, number, "softmax", chain, left_out, of_class=i,
            # A class the fold has not seen keeps the probability 0.
            base=log(n / total) if n else -1e6,
        )
        for i, (name, n) in enumerate(seen.items())
    ]


def _fit(parts: Sequence[Part], models: Sequence[Model], features: Sequence[str], trees: Trees) -> boosting.Fit:
    """All models over the rows of all parts; a part's rows train its own models only."""
    stacked = []
    for i, part in enumerate(parts):
        classes = part.classes
        place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("observed")) - 1 if classes else None
        label = place.cast("double") if classes else F.col("observed").cast("double")
        own = {c: F.col(f"`{c}`").cast("double") for c in features}
        stacked.append(
            part.rows.select(
                F.lit(i).alias("part"), "row_id", F.col("observed").cast("string").alias("observed"), "_test",
                (F.col("fold") + i * FOLDS_PER_PART).alias("_place"),
                F.when(F.col("_train"), label).alias("_y"), *[c.alias(n) for n, c in own.items()],
            )
        )
    rows = reduce(DataFrame.unionByName, stacked)
    labels = [F.when(F.col("part") == i, F.col("_y")) for i in range(len(parts))]
    return boosting.fit(
        rows, features, labels, models, trees, [F.col("_place")], ["part", "row_id", "observed", "_test"]
    )


def _validate(
    parts: Sequence[Part], features: Sequence[str], k: int, trees: Trees, min_train: int, min_test: int
) -> list[Results]:
    """Cross-validation of all parts in one run, a result per part."""
    results = [Results() for _ in parts]
    models: list[Model] = []
    chains: dict[int, tuple[int, int]] = {}
    for i, part in enumerate(parts):
        if sum(n for n, _, _ in part.sizes.values()) < 2 * k:
            continue
        for fold in sorted(part.sizes):
            if part.trained(fold) < max(min_train, 1) or part.sizes[fold][2] < max(min_test, 1):
                continue
            if part.task == "classification" and sum(n > 0 for n in part.seen(fold).values()) < 2:
                continue
            models += _models(part, i, fold, len(chains))
            chains[len(chains)] = (i, fold)
    if not models:
        return results
    fitted = _fit(parts, models, features, trees)
    scored = fitted.held_out(["part", "row_id", "observed", "_test"]).filter("_test")
    for i, part in enumerate(parts):
        own = {c: f for c, (p, f) in chains.items() if p == i}
        if not own:
            continue
        rows = scored.filter(F.col("chain").isin(list(own))).withColumn("fold", F.col("fold") - i * FOLDS_PER_PART)
        if part.task == "classification":
            unseen = [(f, c) for f in own.values() for c, n in part.seen(f).items() if n == 0]
            never = rows.sparkSession.createDataFrame(unseen, "fold int, observed string")
            rows = rows.join(F.broadcast(never), ["fold", "observed"], "left_anti").withColumns(
                {"predicted": class_name(argmax(F.col("scores")), part.classes), "probabilities": F.col("scores")}
            )
            measured = macro_f1(rows, "observed", "predicted", ["fold"]).select("fold", "n", F.col("f1_macro").alias("v"))
        else:
            rows = rows.withColumn("predicted", F.get("scores", F.lit(0)))
            gap = F.abs(F.col("predicted") - F.col("observed").cast("double"))
            measured = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("v"))
        for r in measured.orderBy("fold").collect():
            results[i].folds.append(
                (part.target, part.task, r["fold"], METRIC[part.task], float(r["v"]), part.trained(r["fold"]), r["n"])
            )
        for chain, fold in own.items():
            at = [j for j, m in enumerate(models) if m.chain == chain]
            weights = sum(fitted.ensemble.importances(j) for j in at) / len(at)
            results[i].importances += [(part.target, fold, n, float(w)) for n, w in zip(features, weights)]
        results[i].predictions.append(
            rows.select(
                F.lit(part.target).alias("target"), F.lit(part.task).alias("task"), "fold", "row_id",
                F.col("predicted").cast("string").alias("predicted"), "observed",
                *(["probabilities"] if part.task == "classification" and len(parts) == 1 else []),
            )
        )
    return results


def cross_validate(
    df: DataFrame,
    target: str,
    task: str,
    features: Sequence[str],
    row_id: str,
    group: str = "group",
    k: int = 5,
    trees: Trees = Trees(),
    train_on: Column | None = None,
    test_on: Column | None = None,
    min_train: int = 1,
    min_test: int = 1,
) -> Results:
    """Group-fold cross-validation of one target, all folds and classes in one run.

    ``train_on`` and ``test_on`` restrict the rows a fold trains on and is scored
    on; folds below ``min_train`` or ``min_test`` rows are skipped. Test rows whose
    class a fold has not seen are left out. Predictions of classes carry the
    ``probabilities`` of the sorted class names.
    """
    part = _part(df, target, task, features, row_id, group, k, train_on, test_on)
    return _validate([part], features, k, trees, min_train, min_test)[0]


def cross_validate_all(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    targets: dict[str, str] = values.PHENOTYPE_TARGETS,
    group: str = "group",
    k: int = 5,
    trees: Trees = Trees(),
) -> Results:
    """Every target the table has, in one run."""
    parts = [_part(df, t, task, features, row_id, group, k) for t, task in targets.items() if t in df.columns]
    result = Results()
    for found in _validate(parts, features, k, trees, 1, 1):
        result.add(found)
    return result


@dataclass
class Head:
    """One target of a bundle: its models, class names, and interval per leaf of its spread tree.

    ``intervals`` maps a leaf to what is added to the prediction for ``low_80``, the
    prediction itself and ``high_80``.
    """

    target: str
    task: str
    models: list[int]
    classes: list[str] = field(default_factory=list)
    spread: int | None = None
    intervals: dict[int, tuple[float, float, float]] = field(default_factory=dict)


@dataclass
class Heads:
    """Fitted targets that share their features."""

    heads: list[Head]
    ensemble: Ensemble | None
    spread: Ensemble | None = None

    @property
    def features(self) -> list[str]:
        return self.ensemble.features if self.ensemble else []


def fit_heads(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    targets: dict[str, str] = values.PHENOTYPE_TARGETS,
    trees: Trees = Trees(),
    intervals: bool = True,
    minimum: int = 100,
    group: str = "group",
    k: int = 5,
) -> Heads:
    """Fit every target with at least ``minimum`` labels on all its rows.

    One run grows the models of all targets, and for ``intervals`` those of the group
    folds too. Their out-of-fold residuals train one shallow tree per target on the
    size of the residual. Within each of its leaves the 10th, 50th and 90th
    percentile of the residuals give the interval and shift the prediction to the
    median, so the three cannot cross.
    """
    parts = [
        _part(df, t, task, features, row_id, group, k) for t, task in targets.items() if t in df.columns
    ]
    parts = [p for p in parts if p.trained(-1) >= minimum]
    if not parts:
        return Heads([], None)
    models: list[Model] = []
    heads, chain = [], 0
    for i, part in enumerate(parts):
        final = _models(part, i, -1, chain)
        heads.append(Head(part.target, part.task, list(range(len(models), len(models) + len(final))), part.classes))
        models += final
        chain += 1
    finals = len(models)
    ranged = [i for i, p in enumerate(parts) if intervals and p.task == "regression"]
    for i in ranged:
        for fold in sorted(parts[i].sizes):
            models += _models(parts[i], i, fold, chain)
            chain += 1
    fitted = _fit(parts, models, features, trees)
    bundle = Heads(heads, fitted.ensemble.picked(range(finals)))
    if ranged:
        _fit_intervals(bundle, parts, ranged, fitted, features, row_id)
    return bundle


def _fit_intervals(bundle, parts, ranged, fitted, features, row_id) -> None:
    left = fitted.held_out(["part", "row_id", "observed"]).select(
        "part", "row_id", (F.col("observed").cast("double") - F.get("scores", F.lit(0))).alias("_residual")
    )
    rows = reduce(
        DataFrame.unionByName,
        [parts[i].rows.select(F.lit(i).alias("part"), "row_id", *[F.col(f"`{f}`").cast("double").alias(f) for f in features]) for i in ranged],
    )
    table = materialize(rows.join(left, ["part", "row_id"]))
    labels = [F.when(F.col("part") == i, F.abs("_residual")) for i in ranged]
    models = [Model(parts[i].target, n, "squared", n) for n, i in enumerate(ranged)]
    bundle.spread = boosting.fit(table, features, labels, models, SPREAD).ensemble
    leaves = boosting.with_scores(table, bundle.spread, leaves=True)
    place = F.element_at(F.create_map(*[F.lit(x) for n, i in enumerate(ranged) for x in (i, n)]), F.col("part"))
    named = leaves.select("part", F.get("_scores", place).cast("int").alias("leaf"), "_residual")
    marks = grouped_quantiles(named, ["part", "leaf"], "_residual", {"low": 0.1, "middle": 0.5, "high": 0.9})
    for n, i in enumerate(ranged):
        bundle.heads[i].spread = n
    for r in marks.collect():
        bundle.heads[r["part"]].intervals[r["leaf"]] = (r["low"], r["middle"], r["high"])


def predict_targets(
    genomes: DataFrame, features: Sequence[str], heads: Heads, keep: Sequence[str]
) -> DataFrame:
    """``pred_<target>`` with interval or confidence, in one pass over the genomes.

    ``features`` must be those of the fit, in their order.
    """
    if list(features) != heads.features:
        raise ValueError("the features are not those of the heads, or in another order")
    if heads.ensemble is None:
        return genomes.select(*keep)
    absent = [f for f in features if f not in genomes.columns]
    if absent:
        raise ValueError(f"features of the heads are missing: {absent[:5]}")
    source = genomes.select(*keep, *[F.col(f"`{f}`") for f in features if f not in keep])
    scored = boosting.with_scores(source, heads.ensemble).withColumnRenamed("_scores", "_all")
    if heads.spread is not None:
        scored = boosting.with_scores(scored, heads.spread, leaves=True).withColumnRenamed("_scores", "_leaves")
    columns = []
    for head in heads.heads:
        name = f"pred_{head.target}"
        if head.task == "classification":
            chances = F.slice("_all", head.models[0] + 1, len(head.models))
            columns += [
                class_name(argmax(chances), head.classes).alias(name), F.array_max(chances).alias(f"{name}_confidence")
            ]
            continue
        value = F.get("_all", F.lit(head.models[0]))
        if head.spread is None:
            columns.append(value.alias(name))
            continue
        leaf = F.get("_leaves", F.lit(head.spread)).cast("int")
        for i, suffix in enumerate(("_low_80", "", "_high_80")):
            entries = F.create_map(*[F.lit(x) for at, marks in head.intervals.items() for x in (at, marks[i])])
            columns.append((value + entries[leaf]).alias(f"{name}{suffix}"))
    return scored.select(*keep, *columns)


def save_heads(spark: SparkSession, heads: Heads, path: str) -> None:
    """A bundle in a new folder: trees as Parquet, then a description that makes it complete."""
    if heads.ensemble is None:
        raise ValueError("no target was fitted")
    boosting.save(spark, {"heads": heads.ensemble, **({"spread": heads.spread} if heads.spread else {})}, path, {
        "version": VERSION, "heads": [asdict(h) for h in heads.heads],
    })


def load_heads(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Heads:
    """The bundle of :func:`save_heads`; other ``features`` than its own, or another order, are an error."""
    ensembles, stored = boosting.load(spark, path)
    if stored.get("version") != VERSION:
        raise ValueError(f"bundle of version {stored.get('version')}, expected {VERSION}")
    heads = []
    for h in stored["heads"]:
        marks = {int(leaf): tuple(m) for leaf, m in h.pop("intervals").items()}
        heads.append(Head(**h, intervals=marks))
    bundle = Heads(heads, ensembles["heads"], ensembles.get("spread"))
    if features is not None and list(features) != bundle.features:
        raise ValueError("the features are not those of the bundle, or in another order")
    return bundle


def feature_lift(
    df: DataFrame,
    target: str,
    task: str,
    features_a: Sequence[str],
    features_b: Sequence[str],
    row_id: str,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Fold metrics of two feature sets on the same rows and folds."""
    first = cross_validate(df, target, task, features_a, row_id, **options)
    second = cross_validate(df, target, task, features_b, row_id, **options)
    return first.fold_table(df), second.fold_table(df)


def weak_label_test(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    row_id: str,
    min_train: int = 100,
    min_test: int = 50,
    group: str = "group",
    k: int = 5,
    trees: Trees = Trees(),
) -> DataFrame:
    """Does training on weak labels too help on curated test rows? Both arms are one run."""
    source = F.col(f"{target}_source")
    curated, weak = source == "bacdive", source == "mediadive_weak"
    parts = [
        _part(df, target, "regression", features, row_id, group, k, train_on, curated)
        for train_on in (curated, curated | weak)
    ]
    found = _validate(parts, features, k, trees, min_train, min_test)
    arms = [
        result.fold_table(df).agg(F.avg("value").alias("mae"), F.sum("n_test").alias("n_eval")).withColumn("arm", F.lit(arm))
        for arm, result in zip(("curated", "curated+weak"), found)
    ]
    both = arms[0].unionByName(arms[1])
    wide = both.agg(
        F.max(F.when(F.col("arm") == "curated", F.col("mae"))).alias("mae_curated"),
        F.max(F.when(F.col("arm") == "curated+weak", F.col("mae"))).alias("mae_with_weak"),
        F.max("n_eval").alias("n_eval"),
    )
    a, b = F.col("mae_curated"), F.col("mae_with_weak")
    return wide.select(
        F.lit(target).alias("target"), a, b, "n_eval",
        F.when(a != 0, 100 * (b - a) / a).alias("delta_pct"),
        F.when(a.isNotNull() & b.isNotNull(), weak_label_verdict(a, b)).alias("verdict"),
    )
