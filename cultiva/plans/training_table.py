"""Documents and feature tables to one row per labelled strain."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cultiva.functions.scalars import group_key
from cultiva.operators.encode import one_hot_tags
from cultiva.operators.filters import training_ready
from cultiva.operators.joins import STRAIN_GENOME, fuse_features, join_features, numeric_only


def with_group(df: DataFrame, mode: str = "first_word") -> DataFrame:
    """Add ``group``, the key that may not span two folds."""
    return df.withColumn("group", group_key(F.col("family"), F.col("genus"), F.col("species"), mode))


def build_training_table(
    phenotypes: DataFrame,
    features: DataFrame,
    optional: Iterable[tuple[DataFrame | None, str]] = (),
    min_tag_count: int = 10,
    group_mode: str = "first_word",
) -> tuple[DataFrame, list[str]]:
    """Labelled strains with all their features; returns the feature names too."""
    base = join_features(training_ready(phenotypes), features)
    base, tag_columns = one_hot_tags(with_group(base, group_mode), min_count=min_tag_count)
    tables = list(optional)
    fused = fuse_features(base, tables)
    own = [c for c in numeric_only(features).columns if c not in STRAIN_GENOME]
    extra = [c for c in fused.columns if c not in base.columns]
    return fused, [*own, *tag_columns, *extra]
