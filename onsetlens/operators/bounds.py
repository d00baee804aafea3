"""Latest possible infection day and smallest possible incubation period of a person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from onsetlens.operators.cohorts import COHORTS, Cohort, cohort_names, with_membership


def infection_bounds(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS, by_set: bool = False) -> DataFrame:
    """Infection precedes onset and any positive test before onset, whichever is first.

    A missing result is no positive test.  Persons are reduced before the fan-out over cohorts.
    ``by_set`` leaves out the fan-out: a row stands for all cohorts in ``cohorts``, and no two
    rows of a person share one; a person with tests in different sets has a row per cohort.
    """
    early = F.when(F.col("pcr_result") & (F.col("day_of_test") < F.col("symp_onset_day")), F.col("day_of_test"))
    held = (
        with_membership(tests, cohorts)
        .groupBy("num_id", "cohorts")
        .agg(F.min(early).alias("early"), F.min("symp_onset_day").alias("onset"))
    )
    if by_set:
        key = "cohorts"
        found = _apart(held, cohorts)
    else:
        key = "cohort"
        fanned = held.select(cohort_names(cohorts), "num_id", "early", "onset")
        found = fanned.groupBy("cohort", "num_id").agg(F.min("early").alias("early"), F.min("onset").alias("onset"))
    return found.select(
        key,
        "num_id",
        F.coalesce("early", "onset").alias("te_upper_bound"),
        (F.col("onset") - F.coalesce("early", "onset")).alias("inc_lower_bound"),
    )


def _apart(held: DataFrame, cohorts: Sequence[Cohort]) -> DataFrame:
    """Minima by (num_id, set of cohorts), with sets of a person that share no cohort."""
    persons = held.groupBy("num_id").agg(
        F.bit_or("cohorts").alias("any"),
        F.count(F.lit(1)).alias("sets"),
        F.min("early").alias("early"),
        F.min("onset").alias("onset"),
        # A person has a part per set of cohorts; one alone needs none.
        F.collect_list(F.struct("cohorts", "early", "onset")).alias("parts"),
    )
    bits = [F.lit(1 << bit).cast("long") for bit in range(len(cohorts))]
    member = F.array_compact(F.array(*[F.when(F.col("any").bitwiseAND(bit) != 0, bit) for bit in bits]))
    one = F.col("sets") == 1
    of = persons.withColumn("cohorts", F.explode(F.when(one, F.array("any")).otherwise(member)))
    parts = F.filter("parts", lambda p: p["cohorts"].bitwiseAND(F.col("cohorts")) != 0)
    least = [F.when(one, F.col(name)).otherwise(F.array_min(parts[name])).alias(name) for name in ("early", "onset")]
    return of.select("cohorts", "num_id", *least)


def unplaceable_persons(bounds: DataFrame, cap: float) -> DataFrame:
    """Persons per cohort whose bound leaves no incubation period below ``cap``."""
    return (
        bounds.groupBy("cohort")
        .agg(
            F.count(F.lit(1)).alias("n_persons"),
            F.count_if(F.col("inc_lower_bound") >= cap).alias("n_unplaceable"),
        )
    )
