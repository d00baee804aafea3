"""Delimited test tables whose data may follow a title and a data dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetlens.sources.schema import TESTS

_TRUE, _FALSE = ["true", "t"], ["false", "f"]


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names in file order, from the one line that starts with two known names."""
    line = (
        spark.read.text(path)
        .where(F.col("value").rlike(r'^\W*num_id"?\s*,\s*"?days_since_onset'))
        .first()
    )
    if line is None:
        raise ValueError(f"no header line with num_id and days_since_onset in {path}")
    return [name.strip().strip('"') for name in line["value"].lstrip("\ufeff").split(",")]


def _raw(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    fields = ", ".join(f"`{name or f'blank_{i}'}` string" for i, name in enumerate(names))
    return spark.read.schema(fields).option("mode", "PERMISSIVE").option("escape", '"').csv(path)


def _flag(name: str):
    text = F.lower(F.trim(F.col(name)))
    return F.when(text.isin(_TRUE), F.lit(True)).when(text.isin(_FALSE), F.lit(False))


def load_tests(spark: SparkSession, path: str) -> DataFrame:
    """Typed tests.  Lines before the data have no number in ``num_id`` and are left out."""
    raw = _raw(spark, path, _header(spark, path))
    columns = []
    for field in TESTS.fields:
        kind = field.dataType.simpleString()
        if kind == "boolean":
            value = _flag(field.name)
        elif kind == "string":
            text = F.trim(F.col(field.name))
            value = F.when(~text.isin("NA", ""), text)
        else:
            value = F.trim(F.col(field.name)).try_cast(kind)
        columns.append(value.cast(kind).alias(field.name))
    return raw.where(F.trim(F.col("num_id")).try_cast("bigint").isNotNull()).select(columns)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``load_tests`` leaves out that are no title, dictionary or header line."""
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", ",", "")) != "")
    first = F.trim(F.regexp_extract("value", r'^\W*([^",]*)', 1))
    known = [field.name for field in TESTS.fields] + ["Field name"]
    is_title = F.col("value").rlike(r'^\x{FEFF}?"?\s*[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ ')
    return lines.where(first.try_cast("bigint").isNull() & ~first.isin(known) & ~is_title)


def rejected_counts(spark: SparkSession, path: str) -> DataFrame:
    """(reason, lines): lines left out, and lines kept with a field that could not be read, by reason.

    "no number in num_id" lines are left out by ``load_tests``; the other reasons leave the field
    null and the line in.  Lines of the head count as none; reasons without a line have no row.
    """
    raw = _raw(spark, path, _header(spark, path))
    reasons = []
    for field in TESTS.fields:
        kind, text = field.dataType.simpleString(), F.trim(F.col(field.name))
        given = F.col(field.name).isNotNull() & ~text.isin("NA", "")
        if field.name == "num_id" or kind == "string":
            continue
        readable = _flag(field.name).isNotNull() if kind == "boolean" else text.try_cast(kind).isNotNull()
        reasons.append(F.when(given & ~readable, F.lit(f"unreadable {field.name}")))
    numbered = F.trim(F.col("num_id")).try_cast("bigint").isNotNull()
    kept = raw.where(numbered).select(F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
    left_out = rejected_lines(spark, path).select(F.lit("no number in num_id").alias("reason"))
    return kept.union(left_out).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(field, description) from the lines before the data; empty where a file has none."""
    known = [field.name for field in TESTS.fields]
    raw = spark.read.schema("field string, description string").option("escape", '"').csv(path)
    return raw.where(
        F.trim("field").isin(known) & F.col("description").isNotNull() & ~F.trim("description").isin(known)
    ).select(F.trim("field").alias("field"), F.trim("description").alias("description"))
