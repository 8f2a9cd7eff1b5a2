"""Scalar parsing, labelling and formatting expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cultiva import values

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ACCESSION = r"(?i)^GC[AF]_[0-9]{9}(\.[0-9]+)?$"


def blank_to_null(text: Column) -> Column:
    """NULL for missing, empty and all-blank strings."""
    return F.when(F.trim(text) != "", text)


def empty_to_null(text: Column) -> Column:
    """NULL for missing and empty strings; blanks are kept."""
    return F.when(text != "", text)


def strict_double(text: Column) -> Column:
    """Parse a whole decimal number; anything else is NULL (``1d`` included)."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def to_float(text: Column) -> Column:
    """Lenient measurement parser.

    A range ``a-b`` becomes its midpoint when both parts are whole numbers;
    otherwise the first blank-separated token is parsed.
    """
    trimmed = F.trim(text)
    parts = F.split(trimmed, "-")
    midpoint = (strict_double(parts[0]) + strict_double(parts[1])) / 2
    first_token = F.regexp_extract(trimmed, r"^\S+", 0)
    return F.when(
        trimmed.contains("-") & ~trimmed.startswith("-"), midpoint
    ).otherwise(strict_double(first_token))


def finite(number: Column) -> Column:
    """NULL instead of NaN, so that one kind of missing value remains."""
    return F.when(~F.isnan(number), number)


def present(df: DataFrame, column: str) -> Column:
    """Whether a column holds a value: neither NULL nor NaN."""
    value = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def medium_id_from_link(link: Column) -> Column:
    return empty_to_null(F.regexp_extract(link, r"/medium/([A-Za-z0-9]+)", 1))


def parse_year(text: Column) -> Column:
    """First four-digit year of the 20th or 21st century in free text."""
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def host_kingdom(text: Column) -> Column:
    """Kingdom of the first keyword (in table order) found in ``text``."""
    lowered = F.lower(text)
    result = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for keyword, kingdom in values.HOST_KINGDOM_KEYWORDS:
        result = result.when(lowered.contains(keyword), kingdom)
    return result.otherwise("other")


def phylum(taxonomy: Column) -> Column:
    """First ``p__`` rank of a semicolon-separated lineage, an em dash if none."""
    name = F.trim(F.regexp_extract(taxonomy, r"(?:^|;)\s*p__([^;]*)", 1))
    return F.coalesce(empty_to_null(name), F.lit("—"))


def normalize_accession(accession: Column) -> Column:
    """Drop the ``GB_`` / ``RS_`` prefix."""
    return F.regexp_replace(accession, "^(?:GB_|RS_)(?=.)", "")


def strip_version(accession: Column) -> Column:
    return F.regexp_replace(accession, r"\.[0-9]+$", "")


def bare_accession(genbank: Column, accession: Column) -> Column:
    """Unversioned accession, GenBank column first."""
    return F.when(genbank.startswith("GCA_"), strip_version(genbank)).otherwise(
        strip_version(normalize_accession(F.coalesce(accession, F.lit(""))))
    )


def has_version(accession: Column) -> Column:
    return accession.rlike(r"\.[0-9]+$")


def looks_like_accession(text: Column) -> Column:
    return F.trim(text).rlike(ACCESSION)


def candidate_accessions(accession: Column) -> Column:
    """Accessions to try in order: itself if versioned, else versions 1 to 4."""
    tries = F.array(*[F.concat(accession, F.lit(v)) for v in values.ACCESSION_VERSIONS])
    return F.when(has_version(accession), F.array(accession)).otherwise(tries)


def draw(keys: Sequence[Column | str], seed: int = 0) -> Column:
    """A reproducible random text per key, the same in every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in keys]))


def group_key(
    family: Column, genus: Column, species: Column, mode: str = "first_word"
) -> Column:
    """Leakage group of a strain.

    ``first_word``     family, genus, first word of species
    ``whole_species``  family, genus, species
    ``family``         family only
    """
    unknown = F.lit("__unknown__")
    if mode == "family":
        return F.coalesce(family, unknown)
    if mode == "whole_species":
        return F.coalesce(family, genus, species, unknown)
    if mode != "first_word":
        raise ValueError(f"unknown group mode: {mode}")
    first_word = F.split(F.trim(species), r"\s+")[0]
    return F.coalesce(
        empty_to_null(family), empty_to_null(genus), empty_to_null(first_word), unknown
    )


def map_labels(label: Column, mapping: Mapping[str, str] = values.OXYGEN_COLLAPSE) -> Column:
    """Replace labels found in ``mapping``; keep the others."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[label], label)


def slugify(tag: Column) -> Column:
    """Lower-case column-name form of a tag."""
    named = F.replace(F.replace(F.lower(tag), F.lit(">"), F.lit("gt")), F.lit("<"), F.lit("lt"))
    return F.trim(F.regexp_replace(named, "[^a-z0-9]+", "_"), F.lit("_"))


def place_slug(name: Column) -> Column:
    """Lower-case column-name form of a place."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def feature_family(name: Column) -> Column:
    """Feature group a column name belongs to."""
    marker = F.regexp_extract(name, "^hmm_(.+)_(?:n|score|present)$", 1)
    pairs = [F.lit(x) for _, m, c in values.marker_rows() for x in (m, c)]
    category = F.create_map(*pairs)[marker]
    return (
        F.when(marker != "", F.concat(F.lit("hmm:"), F.coalesce(category, F.lit("unknown"))))
        .when(name.startswith("aa_frac_"), "composition")
        .when(name.startswith("codon_"), "codon")
        .when(name.startswith("tetra_"), "tetra")
        .when(name.startswith("iso_"), "iso")
        .when(name.startswith("md_"), "mediadive")
        .otherwise("baseline")
    )


def safe_float(number: Column, digits: int, default: float | None = 0.0) -> Column:
    """Rounded value for display, ``default`` when missing or NaN.

    The scaled double is rounded, ties to even, so a value one bit off a decimal tie
    counts as the tie when scaling closes the gap.
    """
    value, scale = finite(number.cast("double")), 10.0**digits
    scaled = F.rint(value * scale) / scale + 0.0
    rounded = F.when(F.abs(value) > 1e300, value).otherwise(scaled)
    return rounded if default is None else F.coalesce(rounded, F.lit(float(default)))


def safe_text(text: Column, default: str | None = None) -> Column:
    text = text.cast("string")
    return text if default is None else F.coalesce(text, F.lit(default))


def banded(number: Column, bands: Sequence[tuple[float, str]], above: str) -> Column:
    """Label of the first band whose upper bound exceeds the value."""
    result = F.when(number.isNull(), F.lit(None).cast("string"))
    for upper, label in bands:
        result = result.when(number < upper, label)
    return result.otherwise(above)


def temperature_band(number: Column) -> Column:
    return banded(number, [(15, "<15"), (30, "15-30"), (45, "30-45"), (60, "45-60")], ">=60")


def ph_band(number: Column) -> Column:
    return banded(number, [(6, "<6"), (7.5, "6-7.5")], ">=7.5")


def salt_band(number: Column) -> Column:
    return banded(number, [(1, "<1"), (5, "1-5")], ">=5")


def truly_uncultured(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).startswith("uncultured")
