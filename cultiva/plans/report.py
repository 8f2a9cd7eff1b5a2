"""The evaluation report as tables."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.operators import metrics as M
from cultiva.operators.aggregates import describe_target, error_by_group, top_values


def baselines(dataset: DataFrame, targets: dict[str, str] = values.PHENOTYPE_TARGETS) -> DataFrame:
    """``(target, task, n, baseline)``: error of the constant prediction."""
    parts = []
    for target, task in targets.items():
        if target not in dataset.columns:
            continue
        constant = (
            M.constant_mean_mae(dataset, target).select("n", F.col("mae").alias("baseline"))
            if task == "regression"
            else M.majority_f1(dataset, target).select("n", F.col("f1_macro").alias("baseline"))
        )
        parts.append(
            constant.select(F.lit(target).alias("target"), F.lit(task).alias("task"), "n", "baseline")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def summary(folds: DataFrame, dataset: DataFrame) -> DataFrame:
    """Mean fold metric against the constant baseline."""
    means = folds.groupBy("target", "task").agg(F.avg("value").alias("value"))
    joined = baselines(dataset).join(means, ["target", "task"], "left")
    value, base, task = F.col("value"), F.col("baseline"), F.col("task")
    return joined.select(
        "target",
        "task",
        "n",
        "value",
        "baseline",
        M.improvement_pct(value, base, task).alias("improvement_pct"),
        M.improvement_pct(value, base, task, headline=True).alias("headline_pct"),
    )


def report(
    dataset: DataFrame,
    folds: DataFrame,
    predictions: DataFrame,
    taxonomy: DataFrame,
    features: Sequence[str],
    row_id: str,
    only: Collection[str] | None = None,
) -> dict[str, DataFrame]:
    """All sections, or those of ``only``: distributions, results, correlations, errors per family."""
    regression = predictions.filter(F.col("task") == "regression")
    with_family = regression.join(
        taxonomy.select(F.col(row_id).cast("string").alias("row_id"), "family"), "row_id", "left"
    )
    sections: dict[str, Callable[[], DataFrame]] = {"summary": lambda: summary(folds, dataset), "folds": lambda: folds}
    for target in [t for t in values.REGRESSION_TARGETS if t in dataset.columns]:
        errors = with_family.filter(F.col("target") == target)
        sections[f"distribution_{target}"] = partial(describe_target, dataset, target)
        sections[f"correlations_{target}"] = partial(M.spearman, dataset, features, target, top_n=10)
        sections[f"family_errors_{target}"] = partial(error_by_group, errors)
    if "oxygen_requirement" in dataset.columns:
        sections["oxygen_classes"] = partial(top_values, dataset, ["oxygen_requirement"], 10)
    return {name: make() for name, make in sections.items() if only is None or name in only}
