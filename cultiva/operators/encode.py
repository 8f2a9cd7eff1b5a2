"""Encoders from labels and tags to numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import place_slug, slugify
from cultiva.operators.aggregates import tag_counts, top_values
from cultiva.operators.ordered import row_index
from cultiva.session import materialize


def _slugs(df: DataFrame, tag: str) -> list[tuple[str, str]]:
    """``(tag, slug)`` in tag order; the first tag of a slug wins.

    The rows are the distinct tags that become columns, so what reaches the driver
    is the header of the result. For tags without a bound use the long form.
    """
    rows = df.select(tag, slugify(F.col(tag)).alias("slug")).collect()
    seen: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: r[tag]):
        seen.setdefault(row["slug"], row[tag])
    return [(t, s) for s, t in seen.items()]


def one_hot_tags(
    df: DataFrame,
    columns: Sequence[str] = ("isolation_cat1", "isolation_cat2"),
    min_count: int = 10,
) -> tuple[DataFrame, list[str]]:
    """0/1 column per tag with at least ``min_count`` rows, for ``|``-joined columns.

    A column ``isolation_cat1`` gives ``iso_cat1_<slug>``. Rows without tags get
    zeros.
    """
    added: dict[str, Column] = {}
    for column in columns:
        if column not in df.columns:
            continue
        kept = tag_counts(df, column).filter(F.col("n") >= min_count)
        tags = F.split(F.coalesce(F.col(column), F.lit("")), r"\|")
        level = column.split("_")[1] if "_" in column else column
        for tag, slug in _slugs(kept, "tag"):
            added[f"iso_{level}_{slug}"] = F.array_contains(tags, tag).cast("int")
    return df.withColumns(added), list(added)


def one_hot_tags_long(
    df: DataFrame,
    key: str,
    columns: Sequence[str] = ("isolation_cat1", "isolation_cat2"),
    min_count: int = 10,
) -> DataFrame:
    """``(key, column)`` of all ones of :func:`one_hot_tags`, for any number of tags.

    Nothing reaches the driver. Where two tags share a column, the first by name
    has it.
    """
    parts = []
    for column in columns:
        if column not in df.columns:
            continue
        level = column.split("_")[1] if "_" in column else column
        names = (
            tag_counts(df, column)
            .filter(F.col("n") >= min_count)
            .groupBy(F.concat(F.lit(f"iso_{level}_"), slugify(F.col("tag"))).alias("column"))
            .agg(F.min("tag").alias("_tag"))
        )
        ones = df.select(
            key, F.explode(F.array_distinct(F.split(F.coalesce(F.col(column), F.lit("")), r"\|"))).alias("_tag")
        )
        parts.append(ones.join(names, "_tag").select(key, "column"))
    return reduce(DataFrame.unionByName, parts)


def one_hot_places(df: DataFrame, top_countries: int = 30) -> tuple[DataFrame, list[str]]:
    """Continent (all), country (most frequent) and host kingdom columns.

    The names that become columns reach the driver: they are the result's header.
    Where two names share a slug, the later name in order takes the column.
    """
    added: dict[str, Column] = {}

    def flags(column: str, names: DataFrame) -> None:
        rows = names.select(column, place_slug(F.col(column)).alias("slug")).collect()
        for row in sorted(rows, key=lambda r: r[column]):
            if row["slug"]:
                added[f"{column}_{row['slug']}"] = F.coalesce(
                    (F.col(column) == row[column]).cast("int"), F.lit(0)
                )

    flags("iso_continent", df.select("iso_continent").dropna().distinct())
    flags("iso_country", top_values(df, ["iso_country"], top_countries))
    for kingdom in values.HOST_KINGDOMS:
        added[f"iso_host_kingdom_{kingdom}"] = F.coalesce(
            (F.col("iso_host_kingdom") == kingdom).cast("int"), F.lit(0)
        )
    return df.withColumns(added), list(added)


def label_table(
    features: DataFrame,
    links: DataFrame,
    minimum: int = values.MIN_STRAINS_PER_MEDIUM,
    key: str = "bacdive_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(strains, positives, media)`` of the recommender.

    Strains have features and any link. Positives are distinct ``(strain,
    medium)`` pairs with growth, for media with at least ``minimum`` such links.
    Pairs without a row are negatives, so no strains-by-media grid is built.

    The links are read once: they are counted per pair, which also evens out
    strains with very many links, and that table is kept for the three results.
    """
    pairs = materialize(
        links.groupBy(key, "medium_id")
        .agg(F.count_if(F.lower("growth") == "yes").alias("n_yes"))
        .join(features.select(key).distinct(), key, "left_semi")
    )
    media = (
        pairs.groupBy("medium_id")
        .agg(F.sum("n_yes").alias("n_strains"))
        .filter((F.col("n_strains") >= minimum) & (F.col("n_strains") > 0))
    )
    grown = pairs.filter(F.col("n_yes") > 0).select(key, "medium_id")
    return pairs.select(key).distinct(), grown.join(media, "medium_id", "left_semi").select(key, "medium_id"), media


def label_matrix(
    strains: DataFrame, positives: DataFrame, media: Sequence[str], key: str = "bacdive_id"
) -> DataFrame:
    """0/1 column per medium (named by its id) for every strain."""
    cells = [
        F.coalesce(F.max((F.col("medium_id") == m).cast("tinyint")), F.lit(0).cast("tinyint")).alias(m)
        for m in media
    ]
    return strains.join(positives, key, "left").groupBy(key).agg(*cells)


def class_index(df: DataFrame, label: str) -> dict[str, int]:
    """Alphabetical class numbers of a training set, as a model's list of outputs.

    For a label without a bound on its classes use :func:`class_table`.
    """
    rows = df.select(label).dropna().distinct().collect()
    return {name: i for i, name in enumerate(sorted(str(r[0]) for r in rows))}


def class_table(df: DataFrame, label: str, into: str = "label") -> DataFrame:
    """``(label, into)``: alphabetical class numbers, for any number of classes."""
    names = df.select(F.col(label).cast("string").alias(label)).dropna().distinct()
    return row_index(names, [label], into=into).withColumn(into, F.col(into).cast("double"))


def encode_labels(
    df: DataFrame, label: str, index: dict[str, int] | DataFrame, into: str = "label"
) -> DataFrame:
    """Numeric class; rows whose class is not in ``index`` are dropped.

    ``index`` is that of :func:`class_index` or the table of :func:`class_table`.
    """
    if isinstance(index, DataFrame):
        named = index.select(F.col(label).alias("_class"), F.col(index.columns[-1]).alias(into))
        return df.join(named, F.col(label).cast("string") == F.col("_class")).drop("_class")
    if not index:
        return df.withColumn(into, F.lit(None).cast("double")).limit(0)
    pairs = [F.lit(x) for item in index.items() for x in item]
    coded = F.create_map(*pairs)[F.col(label).cast("string")].cast("double")
    return df.withColumn(into, coded).filter(F.col(into).isNotNull())


def reindex(df: DataFrame, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Exactly ``columns`` in order; absent ones are NULL."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns]
    )


def fill_features(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """NULL and NaN features become ``value``."""
    return df.withColumns(
        {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(value)) for c in columns}
    )


def fill_unknown(df: DataFrame, column: str) -> DataFrame:
    return df.fillna("__unknown__", subset=[column])


def labels_with_mask(
    df: DataFrame,
    classes: Sequence[str] = values.OXYGEN_CLASSES,
    numeric: Sequence[str] = values.REGRESSION_TARGETS,
    oxygen: str = "oxygen_requirement",
) -> DataFrame:
    """``label_<target>`` and 0/1 ``mask_<target>``; unknown classes are masked."""
    added: dict[str, Column] = {}
    for target in numeric:
        added[f"label_{target}"] = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
        added[f"mask_{target}"] = F.col(target).isNotNull().cast("int")
    names = F.array(*[F.lit(c) for c in classes])
    position = F.coalesce(F.array_position(names, F.col(oxygen)), F.lit(0))
    added[f"label_{oxygen}"] = F.greatest(position - 1, F.lit(0)).cast("int")
    added[f"mask_{oxygen}"] = (position > 0).cast("int")
    return df.withColumns(added)


def class_weights(labels: DataFrame, key: str = "medium_id", label: str = "y") -> DataFrame:
    """Negatives over positives per medium, positives counted as at least one."""
    counted = labels.groupBy(key).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )
    return counted.withColumn(
        "weight", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))
    )
