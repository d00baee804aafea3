"""Cohorts as one declarative table, applied in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from onsetlens.session import materialise


@dataclass(frozen=True)
class Cohort:
    """A conjunction of equalities on the test table, and its place in a comparison panel."""

    name: str
    where: dict = field(hash=False)
    panel: str = "main"
    label: str = ""
    order: int = 1

    def predicate(self) -> Column:
        test = F.lit(True)
        for column, value in self.where.items():
            test = test & (F.col(column) == F.lit(value))
        return test


_INC = {"included_main_analysis": "Include"}

# The cohorts compared, with their panel, label and order in the panel.
COHORTS = (
    Cohort("AllTests", _INC, "main", "All tests", 1),
    Cohort("VaccinatedDelta", _INC | {"time_period": "Third", "immunised": "Yes"}, "A", "Vaccinated", 2),
    Cohort("UnvaccinatedDelta", _INC | {"time_period": "Third", "immunised": "No"}, "A", "Unvaccinated", 1),
    Cohort("Domestic", _INC | {"overseas": "No"}, "B", "Domestic", 1),
    Cohort("Overseas", _INC | {"overseas": "Yes"}, "B", "Overseas", 2),
    Cohort("Female", _INC | {"gender": "Female"}, "C", "Female", 1),
    Cohort("Male", _INC | {"gender": "Male"}, "C", "Male", 2),
    Cohort("Over40", _INC | {"age_group": "over40"}, "D", "> 40", 2),
    Cohort("Under40", _INC | {"age_group": "under40"}, "D", "<= 40", 1),
    Cohort("Comorb", _INC | {"comorbidities": 1}, "E", "At least one", 1),
    Cohort("NoComorb", _INC | {"comorbidities": 0}, "E", "None", 2),
    Cohort("Maori", _INC | {"ethnicity": "Maori"}, "F", "Maori", 1),
    Cohort("Pacific", _INC | {"ethnicity": "Pacific"}, "F", "Pacific", 2),
    Cohort("Other", _INC | {"ethnicity": "Other"}, "F", "non-Maori & non-Pacific", 3),
    Cohort("PreJune20", {"time_period": "First"}, "S", "-15/6/20", 1),
    Cohort("June20-June21", {"time_period": "Second"}, "S", "15/6/20-30/6/21", 2),
    Cohort("PostJuly21", {"time_period": "Third"}, "S", "1/7/21-", 3),
)


MASK_BITS = 62


def with_membership(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """Add ``cohorts``, a bit per cohort a test is in; tests in none are left out.

    Aggregates group by this one number first and fan out over cohorts afterwards, so that rows
    are multiplied only once they are few.
    """
    if len(cohorts) > MASK_BITS:
        raise ValueError(f"at most {MASK_BITS} cohorts at once")
    mask = F.lit(0).cast("long")
    for bit, cohort in enumerate(cohorts):
        mask = mask + F.when(cohort.predicate(), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return tests.withColumn("cohorts", mask).where(F.col("cohorts") != 0)


def cohort_names(cohorts: Sequence[Cohort] = COHORTS) -> Column:
    """The names behind the bits of ``cohorts``, a row each."""
    named = [
        F.when(F.col("cohorts").bitwiseAND(F.lit(1 << bit).cast("long")) != 0, F.lit(cohort.name))
        for bit, cohort in enumerate(cohorts)
    ]
    return F.explode(F.array_compact(F.array(*named))).alias("cohort")


def assign_cohorts(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """One row per (cohort, test)."""
    member = with_membership(tests, cohorts)
    return member.select(cohort_names(cohorts), *[c for c in member.columns if c != "cohorts"])


def counted_tests(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS, by_set: bool = False) -> DataFrame:
    """Equal tests of a person with their number ``n``, per cohort; tests are aligned.

    They are counted before the first shuffle and before the fan-out, so a person with a large
    share of all tests weighs no more than one with a test on every day.  ``by_set`` leaves out
    the fan-out: a row stands for all cohorts in ``cohorts``.
    """
    counted = (
        with_membership(tests, cohorts)
        .groupBy("num_id", "cohorts", "symp_onset_day", "day_of_test", "pcr_result")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select("cohorts" if by_set else cohort_names(cohorts), "num_id", "symp_onset_day", "day_of_test", "pcr_result", "n")


def cohort_persons(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """Distinct (cohort, num_id) with the tests of each; a person with many tests is summed early."""
    return (
        with_membership(tests, cohorts)
        .groupBy("num_id", "cohorts")
        .agg(F.count(F.lit(1)).alias("tests"))
        .select(cohort_names(cohorts), "num_id", "tests")
        .groupBy("cohort", "num_id")
        .agg(F.sum("tests").alias("tests"))
    )


def cohort_counts(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """N tests and P persons per cohort."""
    return (
        cohort_persons(tests, cohorts)
        .groupBy("cohort")
        .agg(F.sum("tests").alias("n_tests"), F.count(F.lit(1)).alias("n_persons"))
    )


def dense_ids(persons: DataFrame) -> DataFrame:
    """Number the distinct persons of each cohort 1..P in the order of ``num_id``.

    A window over a whole cohort would sort it in one task.  Instead the distinct persons are
    range-partitioned, numbered within each range, and shifted by the sizes of the ranges
    before.  The ranges are written once, because a range partitioner samples its input and
    may cut elsewhere when a lost task runs again.
    """
    spark = persons.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(
        persons.select("cohort", "num_id")
        .distinct()
        .repartitionByRange(ranges, "cohort", "num_id")
        .withColumn("range", F.spark_partition_id())
    )
    before = Window.partitionBy("cohort").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per cohort and range: bounded by the number of ranges, not by persons.
    shifts = (
        cut.groupBy("cohort", "range")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("cohort", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("cohort", "range").orderBy("num_id")
    return (
        cut.withColumn("position", F.row_number().over(within))
        .join(F.broadcast(shifts), ["cohort", "range"])
        .select("cohort", "num_id", (F.col("position") + F.col("shift")).cast("long").alias("new_id"))
    )


def renumber(cohort_tests: DataFrame) -> DataFrame:
    """Tests with ``new_id`` joined by person (left outer, as an unmatched test stays)."""
    return cohort_tests.join(dense_ids(cohort_tests), ["cohort", "num_id"], "left")


def subject_onsets(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """Distinct (cohort, num_id, symp_onset_day); duplicates go before the fan-out."""
    return (
        with_membership(tests, cohorts)
        .select("cohorts", "num_id", "symp_onset_day")
        .distinct()
        .select(cohort_names(cohorts), "num_id", "symp_onset_day")
        .distinct()
    )
