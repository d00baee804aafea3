"""Values that the data dictionary does not document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from onsetlens.sources.schema import DOCUMENTED, TESTS


CODED = [field.name for field in TESTS.fields if field.name not in ("num_id", "days_since_onset")]


def dictionary_rules(dictionary: DataFrame) -> DataFrame:
    """(field, value) of the values a dictionary documents, from its descriptions.

    A description that starts with "a/b/c" lists values, and so does one of parts "a: meaning;
    b: meaning" or "a=meaning; b=meaning", after a sentence that introduces them.  Values are
    compared in lower case.  A field whose description lists none has no row.
    """
    text = F.lower(F.trim("description"))
    listed = F.regexp_extract(text, r"^([\w.]+(?:/[\w.]+)+)(?:\s+[a-z ]+\.?)?$", 1)
    parts = F.split(F.regexp_replace(text, r"^[^:=;]*\.\s+", ""), ";")
    named = F.transform(parts, lambda part: F.regexp_extract(part, r"^\s*([\w.]+?(?:/[\w.]+?)*)\s*(?:[:=]|\.?\s*$)", 1))
    has_parts = text.rlike("[:=][^;]*;")
    values = F.when(listed != "", F.split(listed, "/")).when(has_parts, F.flatten(F.transform(named, lambda v: F.split(v, "/"))))
    return (
        dictionary.where(F.col("field").isin(CODED))
        .select("field", F.explode(values).alias("value"))
        .where("value <> ''")
        .distinct()
    )


def check_against_dictionary(tests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(field, rows_read, nulls, outside, documented) of every field the dictionary has a row for.

    ``outside`` counts the values that no rule documents; where the description gives no rule
    ``documented`` is 0, and so is ``outside``.  Equal values are counted before they meet the rules, a few rows per coded field.
    """
    rules = dictionary_rules(dictionary)
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.lower(F.col(name).cast("string")).alias("value")) for name in CODED])
    counted = tests.select(F.inline(fields)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    known = rules.withColumn("known", F.lit(True))
    per_field = rules.groupBy("field").agg(F.count(F.lit(1)).alias("documented"))
    found = (
        counted.join(F.broadcast(known), ["field", "value"], "left")  # the documented values of eleven fields
        .groupBy("field")
        .agg(
            F.sum("n").alias("rows_read"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
            F.sum(F.when(F.col("value").isNotNull() & F.col("known").isNull(), F.col("n")).otherwise(0)).alias("outside"),
        )
    )
    return (
        dictionary.where(F.col("field").isin(CODED)).select("field").distinct()
        .join(found, "field")
        .join(per_field, "field", "left")
        .select(
            "field",
            "rows_read",
            "nulls",
            F.when(F.col("documented") > 0, F.col("outside")).otherwise(0).alias("outside"),
            F.coalesce("documented", F.lit(0)).alias("documented"),
        )
    )


def check_values(tests: DataFrame) -> DataFrame:
    """Per field: rows, nulls and values outside the documented ones, in one pass."""
    sums = [F.count(F.lit(1)).alias("rows_read")]
    for field in TESTS.fieldNames():
        sums.append(F.count_if(F.col(field).isNull()).alias(f"{field}__nulls"))
        if field in DOCUMENTED:
            outside = ~F.col(field).cast("string").isin(DOCUMENTED[field])
        else:
            outside = F.lit(False)
        sums.append(F.count_if(outside).alias(f"{field}__outside"))
    wide = tests.agg(*sums)
    reports = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.col(f"{field}__nulls").alias("nulls"),
                F.col(f"{field}__outside").alias("outside"),
            )
            for field in TESTS.fieldNames()
        ]
    )
    return wide.select("rows_read", F.inline(reports))
