"""Cohort comparisons: the numbers behind each panel of a figure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from onsetlens.operators.cohorts import COHORTS, Cohort


def panels(
    curve_summary: DataFrame,
    empirical_curve: DataFrame,
    cohorts: Sequence[Cohort] = COHORTS,
    only: str | None = None,
) -> DataFrame:
    """(panel, group, group_ord, series, x, y, top, bottom) of the curves and empirical curves."""
    chosen = [c for c in cohorts if only is None or c.panel == only]
    spark = curve_summary.sparkSession
    # One row per declared cohort.
    legend = spark.createDataFrame(
        [(c.name, c.panel, c.label, c.order) for c in chosen],
        "cohort string, panel string, group string, group_ord int",
    )
    curves = curve_summary.select(
        "cohort",
        F.lit("curve").alias("series"),
        F.col("days_since_infection").alias("x"),
        F.col("median").alias("y"),
        F.col("upper_95").alias("top"),
        F.col("lower_95").alias("bottom"),
    )
    empirical = empirical_curve.select(
        "cohort",
        F.lit("empirical").alias("series"),
        F.col("x").cast("double").alias("x"),
        F.col("mean").alias("y"),
        "top",
        "bottom",
    )
    names = [c.name for c in chosen]
    return (
        curves.unionByName(empirical)
        .where(F.col("cohort").isin(names))
        .join(F.broadcast(legend), "cohort")
        .select("panel", "group", "group_ord", "series", "x", "y", "top", "bottom")
    )
