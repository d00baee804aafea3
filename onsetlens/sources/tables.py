"""Test tables bound to the driver's star schema: an order is a person, a line is a test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _days(timestamp: str, origin: str):
    return F.datediff(F.col(timestamp).cast("date"), F.lit(origin).cast("date"))


def bind_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Each table is reduced to the columns a test needs before it is joined."""

    def table(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem").select(
        F.col("l_orderkey").alias("num_id"),
        (F.pmod(_days("l_shipdate", "1992-01-01"), F.lit(51)) - 10).cast("int").alias("days_since_onset"),
        (F.col("l_returnflag") == "R").alias("pcr_result"),
    )
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = table("orders").select(
        F.col("o_orderkey").alias("num_id"),
        "o_custkey",
        F.when(status == "F", "First").when(status == "O", "Second").otherwise("Third").alias("time_period"),
        F.when(status == "F", "Exclude").otherwise("Include").alias("included_main_analysis"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Yes")
        .when(priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), "No")
        .otherwise("Unknown")
        .alias("immunised"),
        F.when(F.col("o_custkey") % 3 == 0, "Female")
        .when(F.col("o_custkey") % 3 == 1, "Male")
        .otherwise("Unknown")
        .alias("gender"),
    )
    segment, region = F.col("c_mktsegment"), F.col("n_regionkey")
    customers = table("customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), "Yes")
        .when(segment.isin("FURNITURE", "HOUSEHOLD"), "No")
        .otherwise("Unknown")
        .alias("overseas"),
        F.when(F.col("c_acctbal") < 4500, "under40").otherwise("over40").alias("age_group"),
        F.col("c_nationkey").alias("n_nationkey"),
        (F.col("c_nationkey") % 2).cast("int").alias("comorbidities"),
    )
    nations = table("nation").select(
        "n_nationkey",
        F.when(region == 0, "Maori")
        .when(region == 1, "Pacific")
        .when(region == 4, "Unknown")
        .otherwise("Other")
        .alias("ethnicity"),
    )
    # Persons are completed first, so the long table of tests is shuffled once, by person.
    persons = orders.join(customers.join(nations, "n_nationkey"), "o_custkey")
    return lines.join(persons, "num_id").select(
        "num_id",
        "days_since_onset",
        "pcr_result",
        "time_period",
        "included_main_analysis",
        "immunised",
        "overseas",
        "gender",
        "age_group",
        "comorbidities",
        "ethnicity",
    )


def bind_events(spark: SparkSession, folder: str) -> DataFrame:
    """Many tests per person: a user is a person, an event is a test."""
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").alias("num_id"),
        (_days("ts", "2024-01-01") - 10).cast("int").alias("days_since_onset"),
        (F.col("event_type") == "purchase").alias("pcr_result"),
    )
