"""Tables of medians, means and 95 % bands over draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from onsetlens.operators.model import PARAMETERS, curve

_TAILS = [0.025, 0.5, 0.975]


def _keys(df: DataFrame, *more: str) -> list[str]:
    return [name for name in ("scenario", "cohort") if name in df.columns] + list(more)


def _copies(df: DataFrame):
    """Resampled draws repeat parameter rows: a row with ``copies`` counts that often."""
    return F.col("copies") if "copies" in df.columns else F.lit(1)


def parameter_summary(draws: DataFrame) -> DataFrame:
    """Median, mean and 95 % limits of the four parameters, and of ``inc1`` where it is given.

    ``inc1`` is the incubation period of the person with the lowest id; its figures are null
    where that person cannot be placed.
    """
    # The names under which the parameters are reported.
    names = {"Cutpoint": "cutpoint", "Beta1": "beta1", "Beta2": "beta2", "Beta3": "beta3", "Inc1": "inc1"}
    given = {label: name for label, name in names.items() if name in draws.columns}
    wide = draws.select(
        *_keys(draws), _copies(draws).alias("copies"), *[F.col(name).alias(label) for label, name in given.items()]
    )
    long = wide.unpivot([*_keys(draws), "copies"], list(given), "Parameter", "value")
    limits = F.percentile("value", _TAILS, F.col("copies"))
    return (
        long.groupBy(*_keys(draws, "Parameter"))
        .agg(limits.alias("q"), F.try_divide(F.sum(F.col("value") * F.col("copies")), F.sum("copies")).alias("mean"))
        .select(
            *_keys(draws, "Parameter"),
            F.col("q")[1].alias("median"),
            "mean",
            F.col("q")[0].alias("CI95Low"),
            F.col("q")[2].alias("CI95Up"),
        )
    )


def curve_summary(points: DataFrame) -> DataFrame:
    """Median and 95 % band per cohort and tenth of a day.

    A group holds one value per distinct parameter row, which is bounded by the fit.
    """
    return (
        points.groupBy(*_keys(points, "k"))
        .agg(F.percentile("p", _TAILS, _copies(points)).alias("q"))
        .select(
            *_keys(points),
            (F.col("k") / 10).alias("days_since_infection"),
            F.col("q")[1].alias("median"),
            F.col("q")[0].alias("lower_95"),
            F.col("q")[2].alias("upper_95"),
        )
    )


def infection_day_positivity(cohort_tests: DataFrame, infection_draws: DataFrame) -> DataFrame:
    """(cohort, draw, x, pos, n): every test met with every draw of its person's infection day.

    Tests of a person on one day are counted before the join (a row with ``n`` stands for so
    many equal tests), so a person with many tests does not multiply the draws; the counts are
    summed map-side by (draw, day).  Tests without a day or a result are not counted.  Draws
    packed as ``first`` and ``inf_days`` are unpacked after the join, which then sorts persons.
    """
    number = F.col("n") if "n" in cohort_tests.columns else F.lit(1)
    counted = (
        cohort_tests.where(F.col("pcr_result").isNotNull() & F.col("day_of_test").isNotNull())
        .groupBy("cohort", "num_id", "day_of_test")
        .agg(F.sum(F.when(F.col("pcr_result"), number).otherwise(0)).alias("pos"), F.sum(number).alias("n"))
    )
    x = (F.col("day_of_test") - F.rint("inf_day")).cast("int").alias("x")
    met = counted.join(infection_draws, ["cohort", "num_id"])
    if "inf_days" in infection_draws.columns:
        met = met.select("*", F.posexplode("inf_days").alias("place", "inf_day"))
        met = met.withColumn("draw", F.col("first") + F.col("place"))
    return (
        met.select(*_keys(infection_draws), "draw", x, "pos", "n")
        .groupBy(*_keys(infection_draws, "draw", "x"))
        .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    )


def empirical_curve(counts: DataFrame) -> DataFrame:
    """Mean and 95 % band over draws of the positive share on each day since infection.

    A day without a test in a draw is absent from that draw, not zero.
    """
    limits = F.percentile("share", [0.025, 0.975])
    return (
        counts.where(F.col("x") >= 0)
        .withColumn("share", F.col("pos") / F.col("n"))
        .groupBy(*_keys(counts, "x"))
        .agg(limits.alias("q"), F.avg("share").alias("mean"))
        .select(
            *_keys(counts, "x"),
            F.col("q")[1].alias("top"),
            "mean",
            F.col("q")[0].alias("bottom"),
        )
    )


def weighted_curve_summary(weights: DataFrame, k_max: int = 500) -> DataFrame:
    """``curve_summary`` straight from weighted parameter rows, without resampled copies.

    A quantile is the smallest value at which the running weight reaches its share.  Rows of no
    weight are left out first; a group holds one value per parameter row of the fit.
    """
    key = _keys(weights)
    points = curve(weights.where("weight > 0").select(*key, "param_id", "weight", *PARAMETERS), k_max)
    ranked = Window.partitionBy(*key, "k").orderBy("p", "param_id")
    upto = F.sum("weight").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return (
        points.withColumn("upto", upto)
        .groupBy(*key, "k")
        .agg(*[F.min(F.when(F.col("upto") >= share, F.col("p"))).alias(f"q{i}") for i, share in enumerate(_TAILS)])
        .select(
            *key,
            (F.col("k") / 10).alias("days_since_infection"),
            F.col("q1").alias("median"),
            F.col("q0").alias("lower_95"),
            F.col("q2").alias("upper_95"),
        )
    )
