"""Expressions over VARIANT documents whose fields change shape.

A field may be absent, a scalar, an object or a list of objects, so nothing here
relies on an inferred schema.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cultiva import values
from cultiva.functions.scalars import empty_to_null, to_float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    Spark re-evaluates an expression inside a lambda at every mention; a lambda
    variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def path(*fields: str) -> str:
    """Variant path for field names that may contain blanks."""
    return "$" + "".join(f"['{field}']" for field in fields)


def field(doc: Column, *fields: str) -> Column:
    """Sub-document as VARIANT; JSON ``null`` becomes NULL."""
    value = F.try_variant_get(doc, path(*fields), "variant")
    return F.when(~F.is_variant_null(value), value)


def text(doc: Column, *fields: str) -> Column:
    """Scalar field as string, whatever JSON type it has."""
    return F.try_variant_get(doc, path(*fields), "string")


def only_text(doc: Column, *fields: str) -> Column:
    """Field as string, NULL unless the JSON value is itself a string."""
    return let(
        F.try_variant_get(doc, path(*fields), "variant"),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )


def truthy(doc: Column, *fields: str) -> Column:
    """Field as string, NULL for empty strings, zero, false and empty containers."""

    def kept(value: Column) -> Column:
        as_text = F.try_variant_get(value, "$", "string")
        falsy = F.when(F.schema_of_variant(value) == "STRING", as_text == "").otherwise(
            as_text.isin("false", "[]", "{}") | (as_text.try_cast("double") == 0)
        )
        return F.when(~F.coalesce(falsy, F.lit(False)), as_text)

    return let(F.try_variant_get(doc, path(*fields), "variant"), kept)


def as_list(value: Column) -> Column:
    """Scalar-or-list to list; missing and JSON ``null`` give an empty list."""
    empty = F.expr("cast(array() as array<variant>)")

    def coerced(v: Column) -> Column:
        return (
            F.when(v.isNull() | F.is_variant_null(v), empty)
            .when(
                F.schema_of_variant(v).startswith("ARRAY"),
                F.try_variant_get(v, "$", "array<variant>"),
            )
            .otherwise(F.array(v))
        )

    return let(value, coerced)


def list_at(doc: Column, *fields: str) -> Column:
    return as_list(F.try_variant_get(doc, path(*fields), "variant"))


def entries_at(doc: Column, schema: str, *fields: str) -> Column:
    """Scalar-or-list field as an array of structs, read in one pass over its values.

    ``schema`` lists the members (``name type, ...``). Entries that are no objects are
    NULL, and so is every member that is absent or of another shape.
    """
    entry = f"struct<{schema}>"
    listed = F.try_variant_get(doc, path(*fields), f"array<{entry}>")
    return F.coalesce(listed, F.array(F.try_variant_get(doc, path(*fields), entry)))


def array_mean(numbers: Column) -> Column:
    def mean(xs: Column) -> Column:
        return F.when(
            F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x) / F.size(xs)
        )

    return let(numbers, mean)


def array_median(numbers: Column) -> Column:
    def middle(xs: Column) -> Column:
        n = F.size(xs)
        low = F.get(xs, F.floor((n - 1) / 2).cast("int"))
        return F.when(n > 0, (low + F.get(xs, F.floor(n / 2).cast("int"))) / 2)

    return let(F.array_sort(numbers), middle)


def _pick(entries: Column, keep: str) -> Column:
    """Values of the parsed entries whose boolean member ``keep`` is true."""
    kept = F.filter(entries, lambda e: e[keep] & e["value"].isNotNull())
    return F.transform(kept, lambda e: e["value"])


def _mean_or_median(entries: Column) -> Column:
    return let(
        entries,
        lambda e: F.coalesce(array_mean(_pick(e, "optimum")), array_median(_pick(e, "growth"))),
    )


def _lowered(text_: Column) -> Column:
    return F.lower(F.coalesce(text_, F.lit("")))


def _positive(entry: Column) -> Column:
    return _lowered(entry["growth"]).isin(*values.POSITIVE_GROWTH)


def derive_optimum(doc: Column, *fields: str, key: str) -> Column:
    """Mean of the explicit optima, else median of the positive growth values."""
    schema = f"`type` string, `growth` string, `{key}` string"

    def parse(entry: Column) -> Column:
        kind = _lowered(entry["type"])
        optimum = kind.contains("optim")
        return F.struct(
            to_float(entry[key]).alias("value"),
            optimum.alias("optimum"),
            (~optimum & (kind == "growth") & _positive(entry)).alias("growth"),
        )

    return _mean_or_median(F.transform(entries_at(doc, schema, *fields), parse))


def derive_salt(doc: Column, *fields: str) -> Column:
    """Salt optimum in percent: sodium chloride entries with positive growth only."""
    schema = (
        "`salt` variant, `growth` string, `tested relation` string, "
        "`concentration` variant, `salt concentration` variant"
    )

    def parse(entry: Column) -> Column:
        salt = F.coalesce(truthy(entry["salt"]), F.lit("NaCl"))
        counts = _positive(entry) & (salt == "NaCl")
        optimum = _lowered(entry["tested relation"]).contains("optim")
        amount = F.coalesce(truthy(entry["concentration"]), truthy(entry["salt concentration"]))
        return F.struct(
            to_float(amount).alias("value"),
            (counts & optimum).alias("optimum"),
            (counts & ~optimum).alias("growth"),
        )

    return _mean_or_median(F.transform(entries_at(doc, schema, *fields), parse))


def _first_present(candidates: Column) -> Column:
    return F.get(F.filter(candidates, lambda x: x.isNotNull()), F.lit(0))


def first_value(doc: Column, *fields: str, key: str) -> Column:
    """First non-empty value of ``key``."""
    entries = entries_at(doc, f"`{key}` variant", *fields)
    return _first_present(F.transform(entries, lambda e: truthy(e[key])))


def first_genome_accession(
    doc: Column,
    *fields: str,
    keys: Sequence[str] = ("INSDC accession", "NCBI accession", "accession"),
) -> Column:
    """First entry that carries any accession; keys are tried in order within it."""
    entries = entries_at(doc, ", ".join(f"`{key}` variant" for key in keys), *fields)
    return _first_present(F.transform(entries, lambda e: F.coalesce(*[truthy(e[k]) for k in keys])))


def first_tax_id(doc: Column, *fields: str, key: str = "NCBI tax id") -> Column:
    """First taxon id that is a whole number."""
    return _first_present(F.transform(entries_at(doc, f"`{key}` bigint", *fields), lambda e: e[key]))


def isolation_categories(entries: Column, level: str) -> Column:
    """Distinct sorted tags of one level joined by ``|``; leading ``#`` removed."""
    raw = F.filter(F.transform(entries, lambda e: only_text(e[level])), lambda tag: F.length(tag) > 0)
    tags = F.transform(raw, lambda tag: F.trim(F.regexp_replace(tag, "^#+", "")))
    return empty_to_null(F.array_join(F.array_sort(F.array_distinct(tags)), "|"))
