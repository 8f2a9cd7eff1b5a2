"""From strain documents to the report in one run."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import present
from cultiva.operators.documents import extract_phenotypes
from cultiva.operators.joins import merge_label_sources
from cultiva.plans.boosting import Trees
from cultiva.plans.phenotype import Results, cross_validate_all
from cultiva.plans.report import report
from cultiva.plans.training_table import build_training_table
from cultiva.session import materialize


@dataclass
class Study:
    """The training table of a run and what its models came to.

    ``dataset`` has one row per strain with a label and features, written once;
    ``features`` are its feature columns. ``results`` is None until :func:`fit`.
    """

    dataset: DataFrame
    features: list[str]
    results: Results | None = None

    def sections(self, only: Collection[str] | None = None) -> dict[str, DataFrame]:
        """Tables of the report, or those of ``only``; those of models are empty before :func:`fit`."""
        results = self.results or Results()
        folds, predictions = results.fold_table(self.dataset), results.prediction_table(self.dataset)
        found = report(self.dataset, folds, predictions, self.dataset, self.features, "bacdive_id", only)
        more = {"corpus": corpus(self.dataset, self.features), "importances": results.importance_table(self.dataset)}
        return found | {name: df for name, df in more.items() if only is None or name in only}


def corpus(dataset: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: strains, features and labelled strains per target (``n_<target>``)."""
    labelled = [
        F.count_if(present(dataset, t)).alias(f"n_{t}") for t in values.PHENOTYPE_TARGETS if t in dataset.columns
    ]
    return dataset.agg(F.count(F.lit(1)).alias("n_strains"), F.lit(len(features)).alias("n_features"), *labelled)


def prepare(
    documents: DataFrame,
    features: DataFrame,
    medium_labels: DataFrame | None = None,
    optional: Iterable[tuple[DataFrame | None, str]] = (),
    min_tag_count: int = 10,
) -> Study:
    """Strain documents and genome features to one training table.

    ``documents`` are parsed strain documents. ``features`` has ``bacdive_id`` and
    ``genome_accession``. ``medium_labels`` fills labels the documents lack and adds a
    ``<target>_source`` column per target. ``optional`` tables are left-joined by
    their key.
    """
    # Tags are counted per column before the table is written: documents are parsed once for all.
    phenotypes = materialize(extract_phenotypes(documents))
    if medium_labels is not None:
        phenotypes = merge_label_sources(phenotypes, medium_labels)
    dataset, names = build_training_table(phenotypes, features, optional, min_tag_count)
    return Study(materialize(dataset), names)


def fit(study: Study, k: int = 5, trees: Trees = Trees()) -> Study:
    """Cross-validate every target in group folds, all in one run."""
    results = cross_validate_all(study.dataset, study.features, "bacdive_id", k=k, trees=trees)
    return Study(study.dataset, study.features, results)
