"""From scored parameter rows to equally weighted draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from onsetlens.operators.model import PARAMETERS

BUCKET = 4096


def _by_key(params: DataFrame) -> list[str]:
    return [name for name in ("scenario", "cohort") if name in params.columns]


def posterior_weights(scored: DataFrame) -> DataFrame:
    """Add ``weight`` (sums to 1 per cohort) and ``ess`` to rows with three log terms.

    Two aggregates and joins of one row per cohort, so a large cohort is summed in many tasks.
    A cohort whose rows are all impossible gets weight 0 and effective size 0.
    """
    key = _by_key(scored)
    rows = scored.withColumn("log_weight", F.col("loglik") + F.col("logprior") - F.col("logproposal"))
    rows = rows.withColumn(
        "log_weight", F.when(~F.isnan("log_weight"), F.col("log_weight")).otherwise(F.lit(float("-inf")))
    )
    tops = rows.groupBy(*key).agg(F.max("log_weight").alias("top"))
    shifted = F.when(F.col("top") > float("-inf"), F.exp(F.col("log_weight") - F.col("top"))).otherwise(0.0)
    rows = rows.join(F.broadcast(tops), key).withColumn("raw", shifted)
    totals = rows.groupBy(*key).agg(
        F.sum("raw").alias("total"), F.sum(F.col("raw") * F.col("raw")).alias("squares")
    )
    some = F.col("total") > 0
    return (
        rows.join(F.broadcast(totals), key)
        .withColumn("weight", F.when(some, F.try_divide("raw", "total")).otherwise(0.0))
        .withColumn("ess", F.when(some, F.try_divide(F.col("total") * F.col("total"), "squares")).otherwise(0.0))
        .drop("log_weight", "top", "raw", "total", "squares")
    )


def resample_copies(weights: DataFrame, n: int = 28_000, u0: float = 0.5) -> DataFrame:
    """Systematic resampling: ``first`` and ``copies`` of each row among n equal draws.

    The running sum is taken within buckets of consecutive ``param_id`` and shifted by the
    buckets before, so no cohort is sorted in one task.
    """
    key = _by_key(weights)
    rows = weights.withColumn("bucket", F.floor(F.col("param_id") / BUCKET))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket: a 4096th of the rows.
    shifts = (
        rows.groupBy(*key, "bucket")
        .agg(F.sum("weight").alias("part"))
        .select(*key, "bucket", F.coalesce(F.sum("part").over(before), F.lit(0.0)).alias("shift"))
    )
    within = Window.partitionBy(*key, "bucket").orderBy("param_id")

    def passed(total):
        # Draws j of 0..n-1 with (j + u0) / n below the running sum.
        return F.least(F.greatest(F.ceil(total * n - u0), F.lit(0)), F.lit(n))

    upto = rows.withColumn("upto", F.sum("weight").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        upto.join(shifts, [*key, "bucket"])
        .withColumn("last", passed(F.col("upto") + F.col("shift")))
        .withColumn("first", F.coalesce(F.lag("last").over(within), passed(F.col("shift"))))
        .withColumn("copies", F.col("last") - F.col("first"))
        .where(F.col("copies") > 0)
        .drop("bucket", "upto", "shift", "last")
    )


def resample_draws(weights: DataFrame, n: int = 28_000, u0: float = 0.5) -> DataFrame:
    """(cohort, draw, param_id, parameters): n equally weighted draws per cohort."""
    copies = resample_copies(weights, n, u0)
    draw = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
    return copies.select(*_by_key(weights), draw.alias("draw"), "param_id", *PARAMETERS)
