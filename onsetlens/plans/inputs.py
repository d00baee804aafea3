"""Parameter rows and draws that both engines derive from the tests.

The operators take parameter rows as a table, so they can be compared with SQL without a
sampler.  These rows follow from whole-table aggregates and whole-number arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from onsetlens.operators.bounds import infection_bounds
from onsetlens.operators.cohorts import COHORTS, Cohort
from onsetlens.operators.positivity import positive_counts

# Fixed values shared with the SQL: a prime below 2^31 and multipliers.
PRIME = 2147483647


def unit(*terms: Column) -> Column:
    """Whole-number combination modulo a prime, as a fraction of it."""
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.pmod(total, F.lit(PRIME)) / float(PRIME)


def day_params(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """A parameter row per (cohort, day of test), with its n and x."""
    day, x, n = F.col("days_since_onset").cast("long"), F.col("x"), F.col("n")
    return positive_counts(tests, "days_since_onset", cohorts).select(
        "cohort",
        (day + 11).alias("param_id"),
        "x",
        "n",
        F.log((x + 0.5) / (n - x + 0.5)).alias("beta1"),
        (-0.005 - 0.1 * unit(n * 48271, x * 69621, day * 16807)).alias("beta2"),
        (-0.001 - 0.01 * unit(n * 69621, x * 16807, day * 48271)).alias("beta3"),
        (1 + 8 * unit(n * 16807, x * 48271, day * 69621)).alias("cutpoint"),
    )


def lattice_params(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS, rows: int = 4) -> DataFrame:
    """A few parameter rows per cohort around its overall share of positives."""
    total = positive_counts(tests, "days_since_onset", cohorts).groupBy("cohort").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")
    )
    i = F.col("param_id")
    return total.withColumn("param_id", F.explode(F.expr(f"sequence(0L, {rows - 1}L)"))).select(
        "cohort",
        "param_id",
        (F.log((F.col("x") + 0.5) / (F.col("n") - F.col("x") + 0.5)) + 0.25 * i).alias("beta1"),
        (-0.01 * (1 + i)).alias("beta2"),
        (-0.002 * (1 + i)).alias("beta3"),
        (3.0 + i).alias("cutpoint"),
    )


def posterior_lattice(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """Parameter rows a posterior deviation or so apart, three heights by two bends by two tops."""
    total = positive_counts(tests, "days_since_onset", cohorts).groupBy("cohort").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")
    )
    height, rest = F.floor(F.col("param_id") / 4), F.pmod("param_id", F.lit(4))
    bend, top = F.floor(rest / 2), F.pmod("param_id", F.lit(2))
    return total.withColumn("param_id", F.explode(F.expr("sequence(0L, 11L)"))).select(
        "cohort",
        "param_id",
        (F.log((F.col("x") + 0.5) / (F.col("n") - F.col("x") + 0.5)) + 1.5 * height / F.sqrt("n")).alias("beta1"),
        (-0.0002 * (1 + bend)).alias("beta2"),
        (-0.0001 * (1 + bend)).alias("beta3"),
        (4.0 + 3 * top).alias("cutpoint"),
    )


def given_infection_arrays(
    tests: DataFrame, draws: int, cohorts: Sequence[Cohort] = COHORTS
) -> DataFrame:
    """(cohort, num_id, first, inf_days): draws 1, 2, ... of a person up to 14 days before the bound."""
    numbers = F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))
    days = F.transform(numbers, lambda draw: F.col("te_upper_bound") - 14 * unit(F.col("num_id") * 48271, draw * 16807))
    return infection_bounds(tests, cohorts).select("cohort", "num_id", F.lit(1).cast("long").alias("first"), days.alias("inf_days"))


def given_infection_days(
    tests: DataFrame, draws: int, cohorts: Sequence[Cohort] = COHORTS
) -> DataFrame:
    """(cohort, draw, num_id, inf_day) up to 14 days before the bound."""
    draw = F.explode(F.expr(f"sequence(1L, {draws}L)")).alias("draw")
    return infection_bounds(tests, cohorts).select("cohort", "num_id", "te_upper_bound", draw).select(
        "cohort",
        "draw",
        "num_id",
        (F.col("te_upper_bound") - 14 * unit(F.col("num_id") * 48271, F.col("draw") * 16807)).alias("inf_day"),
    )
