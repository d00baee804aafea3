"""The test table: one row per test result."""

from __future__ import annotations

from pyspark.sql import types as T

TESTS = T.StructType(
    [
        T.StructField("num_id", T.LongType()),
        T.StructField("days_since_onset", T.IntegerType()),
        T.StructField("pcr_result", T.BooleanType()),
        T.StructField("time_period", T.StringType()),
        T.StructField("included_main_analysis", T.StringType()),
        T.StructField("immunised", T.StringType()),
        T.StructField("overseas", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("comorbidities", T.IntegerType()),
        T.StructField("ethnicity", T.StringType()),
    ]
)

# What the data dictionary documents for each coded field.
DOCUMENTED = {
    "time_period": ["First", "Second", "Third"],
    "included_main_analysis": ["Include", "Exclude"],
    "immunised": ["Yes", "No", "Not.applicable", "Unknown"],
    "overseas": ["Yes", "No", "Unknown", "NULL"],
    "gender": ["Male", "Female", "Unknown"],
    "age_group": ["under40", "over40"],
    "comorbidities": ["1", "0"],
    "ethnicity": ["Maori", "Pacific", "Other", "unknown"],
}

# Fixed value: the day every symptom onset is moved to.  Only differences of days matter,
# except that an infection day below 0 is impossible, so it caps incubation at 30 days.
ONSET_DAY = 30
