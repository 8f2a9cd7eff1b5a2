"""JSON document and JSON-lines scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_documents(texts: DataFrame, text: str = "value", into: str = "doc") -> DataFrame:
    """Add the VARIANT column ``into``; rows that are not one valid JSON value are dropped.

    The JSON reader stops after the first value; read as the only element of an
    array, it also sees whatever follows. The generator keeps the parse from being
    repeated in pushed-down filters.
    """
    value = F.btrim(F.col(text), F.lit(" \t\r\n"))
    closed = ~value.startswith("{") | value.endswith("}")
    parsed = F.when(closed, F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))))

    def element(list_: Column, i: int) -> Column:
        return F.try_variant_get(list_, f"$[{i}]", "variant")

    single = F.filter(F.array(parsed), lambda p: element(p, 0).isNotNull() & element(p, 1).isNull())
    found = texts.select("*", F.explode(single).alias(into)).drop(text)
    return found.withColumn(into, element(F.col(into), 0))


def scan_documents(spark: SparkSession, path: str, id_column: str = "bacdive_id") -> DataFrame:
    """One JSON document per file; the id is the file name without ``.json``.

    Files whose name is not a whole number or whose content is not JSON are
    skipped.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^([+-]?[0-9]+)\.json$", 1)
        .try_cast("bigint")
        .alias(id_column),
        "value",
    )
    return parse_documents(files.filter(F.col(id_column).isNotNull()))


def scan_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Line JSON with a declared schema; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
