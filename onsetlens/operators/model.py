"""The curve, its prior and the likelihood of tests whose infection day is given."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from onsetlens.functions.density import curve_logit, inv_logit, normal_log_density
from onsetlens.operators.cohorts import COHORTS, Cohort, cohort_names
from onsetlens.operators.grid import BASE
from onsetlens.session import materialise

PARAMETERS = ("beta1", "beta2", "beta3", "cutpoint")

PARAM_BLOCK = 256
DIFF_BLOCK = 4096  # distinct (day since infection, result) in a block, about

# Rows of a parameter table that may be broadcast; beyond it the join is salted instead.
# (A row is 40 bytes, so about 20 MB.)
BROADCAST_ROWS = 500_000
SALTS = 64

# Fixed value: upper tail of normal(5, 5) above 0, that is the normal distribution at 1.
_CUTPOINT_TAIL = 0.8413447460685429


def curve(params: DataFrame, k_max: int = 500) -> DataFrame:
    """p at k/10 days since infection, k = 0..k_max, for each parameter row (all other columns kept)."""
    points = params.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k_max))))
    eta = curve_logit(F.col("k") / 10, *[F.col(name) for name in PARAMETERS])
    return points.withColumn("p", inv_logit(eta)).drop(*PARAMETERS)


def param_logprior(params: DataFrame) -> DataFrame:
    """Log prior: normal, half-normal below 0 twice, and normal truncated above 0."""
    half = math.log(2.0)
    inside = (F.col("beta2") <= 0) & (F.col("beta3") <= 0) & (F.col("cutpoint") >= 0)
    value = (
        normal_log_density(F.col("beta1"), 0, 5)
        + (normal_log_density(F.col("beta2"), 0, 1) + half)
        + (normal_log_density(F.col("beta3"), 0, 1) + half)
        + (normal_log_density(F.col("cutpoint"), 5, 5) - math.log(_CUTPOINT_TAIL))
    )
    return params.withColumn("logprior", F.when(inside, value).otherwise(F.lit(float("-inf"))))


def join_params(
    rows: DataFrame, params: DataFrame, salt: str, per_row: int = 1, known: int | None = None, on: Sequence[str] = ("cohort",)
) -> DataFrame:
    """Meet the parameter rows of the same cohort, or of the same ``on``.

    A parameter table of checked size is broadcast.  A larger one is repeated over salts and
    hash-joined, so that no cohort, which may hold most rows, ends in one task.  A row of
    ``params`` stands for ``per_row`` parameter rows; ``known`` is their number where the
    caller made them.
    """
    most = BROADCAST_ROWS // per_row
    if (params.limit(most + 1).count() if known is None else known / per_row) <= most:
        return rows.join(F.broadcast(params), [*on])
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", key).join(salted, [*on, "salt"]).drop("salt")


def param_blocks(params: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """At most PARAM_BLOCK parameter rows (unique whole ``param_id`` per cohort) per row, as arrays.

    Sorted, so that every copy of a block, also of a task that ran again, has one order.
    """
    if "scenario" not in params.columns:
        params = params.withColumn("scenario", F.lit(BASE.name))
    kept = ["param_id", *PARAMETERS, *extra]
    return (
        params.withColumn("param_block", F.floor(F.col("param_id") / PARAM_BLOCK))
        .groupBy("scenario", "cohort", "param_block")
        .agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("rows"))
        .select("scenario", "cohort", "param_block", *[F.col("rows")[name].alias(name) for name in kept])
    )


def test_loglik(params: DataFrame, tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS) -> DataFrame:
    """Log-likelihood of all tests per parameter row, the infection day given in ``inf_day``.

    Tests are first counted by (cohort, days since infection, result); a row with ``n`` stands
    for so many equal tests.  Tests without a day, a result or an infection day do not count.
    A row with ``cohorts`` instead of ``cohort`` stands for all of them and is fanned out once counted.
    The counts are packed into blocks, blocks of parameter rows meet them, and a task hands on
    one sum per parameter row: no row holds a test and a parameter row.
    """
    of = "cohorts" if "cohorts" in tests.columns else "cohort"
    number = F.sum("n") if "n" in tests.columns else F.count(F.lit(1))
    counted = (
        tests.where(F.col("pcr_result").isNotNull() & F.col("day_of_test").isNotNull() & F.col("inf_day").isNotNull())
        .withColumn("diff", (F.col("day_of_test") - F.col("inf_day")).cast("double"))
        .groupBy(of, "diff", "pcr_result")
        .agg(number.alias("n"))
    )
    if of == "cohorts":
        fanned = counted.select(cohort_names(cohorts), "diff", "pcr_result", "n")
        counted = fanned.groupBy("cohort", "diff", "pcr_result").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "day-results")  # read twice, and far fewer rows than tests
    sizes = counted.groupBy("cohort").agg(F.ceil(F.count(F.lit(1)) / DIFF_BLOCK).alias("n_blocks"))
    packed = (
        counted.join(F.broadcast(sizes), "cohort")  # one row per cohort
        .withColumn("block", F.pmod(F.xxhash64("diff", "pcr_result"), F.col("n_blocks")))
        .groupBy("cohort", "block")
        .agg(F.sort_array(F.collect_list(F.struct("diff", F.col("pcr_result").alias("pos"), "n"))).alias("rows"))
        .select("cohort", "block", F.col("rows.diff").alias("diff"), F.col("rows.pos").alias("pos"), F.col("rows.n").alias("n"))
    )

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                beta1, beta2, beta3, cutpoint = (np.asarray(getattr(row, name), float)[:, None] for name in PARAMETERS)
                sign = np.where(np.asarray(row.pos, bool), 1.0, -1.0)
                n, diff = np.asarray(row.n, float), np.asarray(row.diff, float)
                gap = diff - cutpoint
                signed = sign * (beta1 + np.where(gap < 0, beta2, beta3) * gap * gap)
                total = (np.minimum(signed, 0.0) - np.log1p(np.exp(-np.abs(signed)))) @ n
                yield pd.DataFrame({"scenario": row.scenario, "cohort": row.cohort, "param_id": row.param_id, "loglik": total})

    met = join_params(packed, param_blocks(params), "block", PARAM_BLOCK)
    key = ["scenario", "cohort", "param_id"] if "scenario" in params.columns else ["cohort", "param_id"]
    sums = met.mapInPandas(partial_sums, "scenario string, cohort string, param_id long, loglik double")
    return sums.groupBy(*key).agg(F.sum("loglik").alias("loglik"))
