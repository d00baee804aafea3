"""Tables written and read back: delimited summaries, and draws as Parquet by cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from onsetlens.session import parallel_tasks

FILE_BYTES = 256 << 20


def write_csv(df: DataFrame, path: str, quote: bool = True, by: str | None = "cohort") -> None:
    """A header and comma-separated rows; ``quote`` puts text in quotes."""
    if by and by in df.columns:
        # One file per cohort; for summaries, whose rows are bounded by days and parameters.
        writer = df.repartition(by).write.partitionBy(by)
    else:
        writer = df.write
    writer.mode("overwrite").option("header", True).option("quoteAll", quote).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_draws(df: DataFrame, path: str) -> None:
    """Parquet, a folder per cohort, so that one cohort is read without the others."""
    df.write.mode("overwrite").partitionBy("cohort").parquet(path)


def draw_buckets(spark: SparkSession, persons: int, draws: int) -> int:
    """Buckets of a cohort's infection days, so that a file is about FILE_BYTES large."""
    return max(1, -(-persons * draws * 8 // FILE_BYTES))


def _bucket(num_id, buckets: int):
    return F.pmod(F.xxhash64(num_id), F.lit(buckets)).cast("int")


def write_infection_draws(packed: DataFrame, path: str, buckets: int) -> None:
    """Days of each person's draws as Parquet, a folder per cohort and bucket of persons.

    ``packed`` has (scenario, cohort, num_id, first, inf_days).  A bucket of a cohort is written
    by one task as one file, and a hot cohort is ``buckets`` of them.
    """
    spark = packed.sparkSession
    # Hashed to few tasks, files of several cohorts would meet in one while others have none.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets, parallel_tasks(spark))
    (
        packed.withColumn("bucket", _bucket("num_id", buckets))
        .withColumn("buckets", F.lit(buckets))
        .repartition(tasks, "cohort", "bucket")
        .sortWithinPartitions("cohort", "bucket", "scenario", "num_id", "first")
        .write.mode("overwrite")
        .partitionBy("buckets", "cohort", "bucket")
        .parquet(path)
    )


def read_infection_draws(spark: SparkSession, path: str, persons: list[tuple[str, int]] | None = None) -> DataFrame:
    """What ``write_infection_draws`` wrote; of a few (cohort, num_id) only the buckets they are in."""
    schema = "scenario string, num_id long, first long, inf_days array<double>, buckets int, cohort string, bucket int"
    found = spark.read.schema(schema).parquet(path)
    if persons is not None:
        known = F.lit(False)
        for cohort, num_id in persons:
            # The bucket is found when the filter is, so that Spark prunes folders by it.
            known = known | (
                (F.col("cohort") == cohort) & (F.col("bucket") == _bucket(F.lit(num_id).cast("long"), F.col("buckets"))) & (F.col("num_id") == num_id)
            )
        found = found.where(known)
    return found.select("scenario", "cohort", "num_id", "first", "inf_days")


def read_draws(spark: SparkSession, path: str, cohort: str | None = None) -> DataFrame:
    draws = spark.read.parquet(path)
    return draws if cohort is None else draws.where(F.col("cohort") == cohort)
