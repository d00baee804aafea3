"""How far weighted parameter rows can be trusted, and how many tests and persons stand behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from onsetlens.operators.cohorts import COHORTS, Cohort, counted_tests
from onsetlens.operators.grid import BASE, CAP, Scenario

LEAST_TAIL = 5  # weights in a tail whose shape is estimated
# Fixed values of the estimator of the generalised Pareto shape, and of its reading.
PRIOR_POINTS, PRIOR_SCALE, PRIOR_SHAPE, PRIOR_WEIGHT = 30, 3.0, 0.5, 10
HEAVY_TAIL = 0.7


def tail_shape(weights: DataFrame) -> DataFrame:
    """(scenario, cohort, rows, possible_rows, ess, tail_rows, tail_shape) of weighted rows.

    ``tail_shape`` is the shape of a generalised Pareto distribution fitted to the largest
    weights, min(a fifth of the rows, 3 sqrt(rows)) of them, less the next one.  Above 0.7 the
    sample says little about what it stands for, whatever its effective size.  It is null where
    fewer than five weights lie in the tail or a quarter of them are equal to the one below it.
    The fit bounds the rows of a cohort, and only ranks are taken of them in one task.
    """
    key = ["scenario", "cohort"]
    possible = F.count_if(F.col("weight") > 0)
    sizes = weights.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), possible.alias("possible_rows"), F.first("ess").alias("ess")
    )
    sizes = sizes.withColumn(
        "tail_rows", F.least(F.floor(0.2 * F.col("rows")), F.ceil(3 * F.sqrt("rows"))).cast("long")
    )
    ranked = weights.select(
        *key, "weight", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weight"), "param_id")).alias("place")
    )
    tail = (
        ranked.join(F.broadcast(sizes.select(*key, "tail_rows")), key)  # one row per cohort and scenario
        .where(F.col("place") <= F.col("tail_rows") + 1)
    )
    quartile = F.floor(F.col("tail_rows") / 4 + 0.5)  # counted from the smallest
    marks = (
        tail.groupBy(*key, "tail_rows")
        .agg(
            F.max(F.when(F.col("place") == F.col("tail_rows") + 1, F.col("weight"))).alias("cutoff"),
            F.max("weight").alias("most"),
            F.max(F.when(F.col("place") == F.col("tail_rows") + 1 - quartile, F.col("weight"))).alias("quarter"),
        )
        .where((F.col("tail_rows") >= LEAST_TAIL) & (F.col("quarter") > F.col("cutoff")))
        .withColumns({"most": F.col("most") - F.col("cutoff"), "quarter": F.col("quarter") - F.col("cutoff")})
    )
    excess = (
        tail.where(F.col("place") <= F.col("tail_rows"))
        .drop("tail_rows")
        .join(F.broadcast(marks), key)
        .select(*key, "tail_rows", "most", "quarter", (F.col("weight") - F.col("cutoff")).alias("x"))
    )
    # A profile likelihood over a grid of the second parameter, and the mean over that grid.
    points = (F.lit(PRIOR_POINTS) + F.floor(F.sqrt("tail_rows"))).cast("int")
    at = F.explode(F.sequence(F.lit(1), points)).alias("point")
    theta = 1 / F.col("most") + (1 - F.sqrt(points / (F.col("point") - 0.5))) / (PRIOR_SCALE * F.col("quarter"))
    shape = F.sum(F.log1p(-F.col("theta") * F.col("x"))) / F.first("tail_rows")
    profile = (
        excess.select(*key, "tail_rows", "most", "quarter", "x", at)
        .withColumn("theta", theta)
        .groupBy(*key, "tail_rows", "point", "theta")
        .agg(shape.alias("k"))
        .withColumn("loglik", F.col("tail_rows") * (F.log(-F.col("theta") / F.col("k")) - F.col("k") - 1))
    )
    top = F.max("loglik").over(Window.partitionBy(*key))  # some thirty rows per cohort
    mean = (
        profile.withColumn("w", F.exp(F.col("loglik") - top))
        .groupBy(*key)
        .agg((F.sum(F.col("w") * F.col("theta")) / F.sum("w")).alias("theta"))
    )
    # Few weights are drawn towards a shape of one half.
    found = (
        excess.join(F.broadcast(mean), key)
        .groupBy(*key)
        .agg(F.avg(F.log1p(-F.col("theta") * F.col("x"))).alias("k"), F.first("tail_rows").alias("m"))
        .select(*key, ((F.col("k") * F.col("m") + PRIOR_SHAPE * PRIOR_WEIGHT) / (F.col("m") + PRIOR_WEIGHT)).alias("tail_shape"))
    )
    return sizes.join(found, key, "left").select(*key, "rows", "possible_rows", "ess", "tail_rows", "tail_shape")


def cohort_losses(tests: DataFrame, cohorts: Sequence[Cohort] = COHORTS, cap: int = CAP) -> DataFrame:
    """Per cohort: tests, those without a day or a result, persons, and persons that do not count.

    A person counts towards the likelihood if the bound leaves a cell below ``cap``; one without
    a known test counts but says nothing.  Tests are counted per person before any fan-out.
    """
    known = F.col("pcr_result").isNotNull() & F.col("day_of_test").isNotNull()
    early = F.when(F.col("pcr_result") & (F.col("day_of_test") < F.col("symp_onset_day")), F.col("symp_onset_day") - F.col("day_of_test"))
    persons = counted_tests(tests, cohorts).groupBy("cohort", "num_id").agg(
        F.sum("n").alias("tests"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"),
        F.coalesce(F.max(early), F.lit(0)).alias("bound"),
    )
    unplaceable = F.col("bound") >= cap
    return persons.groupBy("cohort").agg(
        F.sum("tests").alias("n_tests"),
        F.sum(F.col("tests") - F.col("known")).alias("n_tests_unknown"),
        F.sum(F.when(unplaceable, F.col("known")).otherwise(0)).alias("n_tests_unplaceable"),
        F.count(F.lit(1)).alias("n_persons"),
        F.count_if(unplaceable).alias("n_unplaceable"),
        F.count_if((F.col("known") == 0) & ~unplaceable).alias("n_without_known_test"),
    )


def fit_report(
    losses: DataFrame,
    weights: DataFrame,
    progress: DataFrame | None = None,
    cohorts: Sequence[Cohort] = COHORTS,
    scenarios: Sequence[Scenario] = (BASE,),
) -> DataFrame:
    """A row per scenario and declared cohort, also where nothing could be fitted, with a verdict.

    ``progress`` holds (scenario, cohort, rounds, power, converged) of an adaptive fit; rows that
    were given count as one round at full power.
    """
    spark = weights.sparkSession
    declared = spark.createDataFrame(
        [(s.name, c.name) for s in scenarios for c in cohorts], "scenario string, cohort string"
    )
    key = ["scenario", "cohort"]
    if progress is None:
        progress = weights.select(*key).distinct().select(*key, F.lit(1).alias("rounds"), F.lit(1.0).alias("power"), F.lit(True).alias("converged"))
    joined = declared.join(losses, "cohort", "left").join(tail_shape(weights), key, "left").join(progress, key, "left")
    counts = [name for name in losses.columns if name != "cohort"] + ["rows", "possible_rows", "tail_rows", "rounds"]
    share = F.try_divide(F.col("ess"), F.col("rows"))
    verdict = (
        F.when(F.col("n_persons").isNull(), "no person")
        .when(F.col("n_unplaceable") == F.col("n_persons"), "no placeable person")
        .when(F.col("rows").isNull(), "not fitted")
        .when(F.col("possible_rows") == 0, "no possible row")
        .when(~F.col("converged"), "not converged")
        .when(F.col("tail_shape") > HEAVY_TAIL, "heavy tail")
        .when(share < 0.1, "few effective rows")
        .otherwise("ok")
    )
    return joined.select(
        *key,
        *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in counts],
        "ess",
        share.alias("ess_share"),
        "tail_shape",
        "power",
        verdict.alias("verdict"),
    )
