"""Coverage, medium, marker and error summaries.

Everything is built from aggregates Spark combines before the shuffle. Exact
medians over unbounded groups go through :mod:`cultiva.operators.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import present, strict_double
from cultiva.operators.ordered import grouped_quantiles
from cultiva.operators.ranking import page


def coverage(df: DataFrame, columns: Sequence[str], joint: Sequence[str] = ()) -> DataFrame:
    """Non-null count and percentage per column, plus one row for ``joint``."""
    tests = {c: F.col(c).isNotNull() for c in columns}
    if joint:
        together = F.lit(True)
        for c in joint:
            together = together & F.col(c).isNotNull()
        tests["+".join(joint)] = together
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(t).alias(f"_c{i}") for i, t in enumerate(tests.values())],
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(f"_c{i}").alias("n"))
            for i, name in enumerate(tests)
        ]
    )
    return counts.select("_rows", F.inline(rows)).select(
        "field",
        "n",
        F.when(F.col("_rows") > 0, 100.0 * F.col("n") / F.col("_rows")).otherwise(0.0).alias("pct"),
    )


def link_counts(links: DataFrame) -> DataFrame:
    """Links, distinct strains and distinct media in one row."""
    return links.agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_distinct("bacdive_id").alias("n_strains"),
        F.count_distinct("medium_id").alias("n_media"),
    )


def growth_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("growth").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Most frequent values, equal counts in value order."""
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return page(counts, [F.col("n").desc(), *columns], n)


def compound_usage(recipes: DataFrame, n: int = 15) -> DataFrame:
    """Compounds by number of media, with the median grams per litre."""
    used = recipes.groupBy("compound").agg(F.count_distinct("medium_id").alias("n_media"))
    top = page(used, [F.col("n_media").desc(), "compound"], n)
    amounts = recipes.join(top.select("compound"), "compound", "left_semi")
    medians = grouped_quantiles(amounts, ["compound"], "g_l", {"median_g_l": 0.5})
    return top.join(medians, "compound", "left")


def medium_ph(metadata: DataFrame) -> DataFrame:
    """Midpoint pH of media that state both limits."""
    low = strict_double(F.col("min_pH").cast("string"))
    high = strict_double(F.col("max_pH").cast("string"))
    return metadata.select("medium_id", ((low + high) / 2).alias("m_ph")).filter(
        F.col("m_ph").isNotNull()
    )


def medium_nacl(recipes: DataFrame) -> DataFrame:
    """Percent sodium chloride per medium, capped."""
    salt = recipes.filter(F.col("compound").rlike(f"(?i){values.NACL_PATTERN}"))
    return salt.groupBy("medium_id").agg(
        F.least(F.coalesce(F.sum("g_l"), F.lit(0.0)) / 10, F.lit(values.NACL_CAP_PCT)).alias("m_nacl")
    )


def strain_medium_features(attached: DataFrame, key: str = "bacdive_id") -> DataFrame:
    """Medium statistics per strain over its positive links.

    Needs ``growth``, ``m_ph`` and ``m_nacl``. The medians are over the distinct
    values of a strain's media, so they are bounded by the number of media.
    """
    grown = attached.filter(F.lower("growth") == "yes")
    return grown.groupBy(key).agg(
        F.count(F.lit(1)).alias("md_n_media"),
        F.median("m_ph").alias("md_ph_median"),
        (F.max("m_ph") - F.min("m_ph")).alias("md_ph_range"),
        F.median("m_nacl").alias("md_nacl_pct_median"),
        F.max("m_nacl").alias("md_nacl_pct_max"),
    )


def frequent_media(links: DataFrame, minimum: int = values.MIN_STRAINS_PER_MEDIUM) -> DataFrame:
    """Media with enough positive links."""
    return (
        links.filter(F.lower("growth") == "yes")
        .groupBy("medium_id")
        .agg(F.count(F.lit(1)).alias("n_strains"))
        .filter(F.col("n_strains") >= minimum)
    )


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per tag of a ``|``-joined column."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(F.explode(F.split(column, r"\|")).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_target(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, p10, median, p90 and the two extreme counts."""
    known = df.filter(present(df, column))
    moments = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.count_if(F.col(column) >= 50).alias("n_ge_50"),
        F.count_if(F.col(column) <= 15).alias("n_le_15"),
    )
    marks = grouped_quantiles(known, keys, column, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    if keys:
        return moments.join(marks, list(keys))
    one = F.lit(1).alias("_one")
    return (
        moments.select("*", one).join(marks.select("*", one), "_one").drop("_one")
    )


def error_by_group(predictions: DataFrame, group: str = "family", n: int = 15) -> DataFrame:
    """Rows and mean absolute error per group (missing group included), largest first."""
    errors = predictions.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("predicted").cast("double") - F.col("observed").cast("double"))).alias("mae"),
    )
    return page(errors, [F.col("n").desc(), F.col(group).asc_nulls_last()], n)


def category_totals(importances: DataFrame, family: Column) -> DataFrame:
    """Summed importance per feature family."""
    return importances.groupBy(family.alias("feature_family")).agg(
        F.sum("importance").alias("importance")
    )


def collect_hits(hits: DataFrame, key: str = "genome_accession", hit: str = "profile") -> DataFrame:
    """Sorted distinct profiles per genome; bounded by the profile library."""
    return hits.groupBy(key).agg(F.array_sort(F.collect_set(hit)).alias("ko_hits"))


def marker_summary(hits: DataFrame, max_evalue: float = values.MAX_EVALUE) -> DataFrame:
    """Hits, best score and the e-value of the best hit per genome and marker.

    A score of zero or less never counts as best.
    """
    kept = hits.filter(F.col("evalue") <= max_evalue)
    best = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("evalue")).alias("negated"))))
    summary = kept.groupBy("genome_accession", "marker").agg(
        F.count(F.lit(1)).alias("n_hits"), best.alias("_best")
    )
    return summary.select(
        "genome_accession",
        "marker",
        "n_hits",
        F.coalesce(F.col("_best.score"), F.lit(0.0)).alias("top_score"),
        F.coalesce(-F.col("_best.negated"), F.lit(1.0)).alias("top_evalue"),
    )


def marker_pivot(
    genomes: DataFrame,
    summary: DataFrame,
    markers: Sequence[str] = tuple(m for _, m, _ in values.marker_rows()),
) -> DataFrame:
    """``hmm_<marker>_{n,score,present}`` per genome, zeros where nothing was hit."""

    found = summary.select(
        "genome_accession", "marker", "n_hits", F.col("top_score").cast("double").alias("top_score")
    )
    grid = genomes.select("genome_accession").distinct().join(found, "genome_accession", "left")
    wide = (
        grid.groupBy("genome_accession")
        .pivot("marker", list(markers))
        .agg(F.first("n_hits").alias("n"), F.first("top_score").alias("score"))
    )
    cells = [
        cell
        for m in markers
        for cell in (
            f"coalesce(cast(`{m}_n` as double), 0D) as `hmm_{m}_n`",
            f"coalesce(`{m}_score`, 0D) as `hmm_{m}_score`",
            f"if(`{m}_n` > 0, 1D, 0D) as `hmm_{m}_present`",
        )
    ]
    return wide.selectExpr("genome_accession", *cells)


def _sum_present(df: DataFrame, names: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for column in (f"hmm_{m}_present" for m in names):
        if column in df.columns:
            total = total + F.col(column)
    return total


def marker_balance(
    wide: DataFrame, aerobic: Sequence[str], anaerobic: Sequence[str]
) -> DataFrame:
    """How many aerobic and anaerobic markers a genome carries."""
    return wide.withColumns(
        {
            "n_aerobic_markers": _sum_present(wide, aerobic),
            "n_anaerobic_markers": _sum_present(wide, anaerobic),
        }
    )


def marker_by_class(balance: DataFrame, labels: DataFrame, label: str = "oxygen_requirement") -> DataFrame:
    """Mean marker counts per oxygen class."""
    return (
        balance.join(labels.filter(F.col(label).isNotNull()), "genome_accession")
        .groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("n_aerobic_markers").alias("mean_aerobic"),
            F.avg("n_anaerobic_markers").alias("mean_anaerobic"),
        )
    )


def fold_means(folds: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of the given columns over folds."""
    return folds.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def summary_median(per_medium: DataFrame, columns: Sequence[str] = ("pr_auc", "roc_auc")) -> DataFrame:
    """Median of per-medium metrics: one value per medium at most."""
    return per_medium.agg(*[F.median(c).alias(f"median_{c}") for c in columns])


def fold_label_counts(manifest: DataFrame) -> DataFrame:
    """Rows and label coverage per fold."""
    return manifest.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("optimal_temperature_c").alias("temperature"),
        F.count("optimal_ph").alias("ph"),
        F.count("salt_tolerance_pct").alias("salt"),
        F.count_if(F.coalesce(F.col("oxygen_requirement"), F.lit("")) != "").alias("oxygen"),
        F.count_if(F.col("n_true_media") > 0).alias("medium"),
    )


def file_coverage(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """How many distinct accessions have a file; ``files`` has ``file_name``."""
    suffix = "|".join(s.replace(".", r"\.") for s in sorted(values.FASTA_SUFFIXES, key=len, reverse=True))
    present = files.select(
        F.regexp_extract("file_name", rf"^(.*?)(?:{suffix})$", 1).alias("genome_accession"),
        F.lit(1).alias("_file"),
    ).distinct()
    wanted = manifest.select("genome_accession").dropna().distinct()
    counted = wanted.join(present, "genome_accession", "left").agg(
        F.count(F.lit(1)).alias("unique_accessions"), F.count("_file").alias("present_fastas")
    )
    n, found = F.col("unique_accessions"), F.col("present_fastas")
    return counted.select(
        n,
        found,
        (n - found).alias("missing_fastas"),
        F.when(n == 0, 0.0).otherwise(100.0 * found / n).alias("coverage_pct"),
    )


def module_prevalence(completeness: DataFrame, n_genomes: Column, n: int = 10) -> DataFrame:
    """Modules by mean completeness; genomes without a row count as zero."""
    means = completeness.groupBy("module").agg(
        (F.sum("completeness") / n_genomes).alias("mean_completeness")
    )
    return page(means, [F.col("mean_completeness").desc(), "module"], n)


