"""Share of positive tests by day, with an exact interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from onsetlens.functions.interval import exact_interval
from onsetlens.operators.cohorts import COHORTS, Cohort, cohort_names, with_membership


def positive_counts(
    tests: DataFrame, by: str = "days_since_onset", cohorts: Sequence[Cohort] = COHORTS
) -> DataFrame:
    """x positives in n known results per (cohort, by), counted before the fan-out.

    Tests without a value of ``by`` are not counted.
    """
    return (
        with_membership(tests.where(F.col(by).isNotNull()), cohorts)
        .groupBy("cohorts", by)
        .agg(F.count_if("pcr_result").alias("x"), F.count("pcr_result").alias("n"))
        .select(cohort_names(cohorts), by, "x", "n")
        .groupBy("cohort", by)
        .agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        .where(F.col("n") > 0)
    )


def positivity_by_day(
    tests: DataFrame,
    by: str = "days_since_onset",
    conf: float = 0.95,
    cohorts: Sequence[Cohort] = COHORTS,
) -> DataFrame:
    """The interval runs in Python on the few aggregated rows, never on tests."""
    counts = positive_counts(tests, by, cohorts)
    limits = exact_interval(F.col("x"), F.col("n"), conf)
    return counts.withColumn("limits", limits).select(
        "cohort",
        F.lit("exact").alias("method"),
        "x",
        "n",
        (F.col("x") / F.col("n")).alias("mean"),
        F.col("limits.lower").alias("lower"),
        F.col("limits.upper").alias("upper"),
        F.col(by).alias("tSinceOnset"),
    )
