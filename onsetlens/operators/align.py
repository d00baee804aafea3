"""Days counted from a common symptom onset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from onsetlens.sources.schema import ONSET_DAY


def align_days(tests: DataFrame, onset_day: int = ONSET_DAY) -> DataFrame:
    return tests.withColumn("symp_onset_day", F.lit(onset_day)).withColumn(
        "day_of_test", F.col("symp_onset_day") + F.col("days_since_onset")
    )
