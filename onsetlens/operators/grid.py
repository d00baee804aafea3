"""Incubation periods on a grid of equal cells, truncated below at a person's bound."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from onsetlens.functions.density import lognormal_log_kernel


@dataclass(frozen=True)
class Scenario:
    """Log-normal incubation prior; ``mu`` and ``sd`` are those of the logarithm."""

    name: str
    mu: float
    sd: float


# The incubation prior and its four variations.
BASE = Scenario("base", 1.621, 0.418)
SCENARIOS = (
    BASE,
    Scenario("high_mean_high_sd", 1.685, 0.4871),
    Scenario("low_mean_high_sd", 1.557, 0.4871),
    Scenario("low_mean_low_sd", 1.557, 0.3489),
    Scenario("high_mean_low_sd", 1.685, 0.3489),
)

STEP, CAP = 0.5, 30


def cell_count(step: float, cap: int) -> int:
    cells = round(cap / step)
    if abs(cells * step - cap) > 1e-9 or abs(round(1 / step) * step - 1) > 1e-9:
        raise ValueError("step must divide 1, because lower bounds are whole days")
    return cells


def incubation_grid(
    bounds: DataFrame,
    scenarios: Sequence[Scenario] = (BASE,),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> DataFrame:
    """(scenario, inc_lower_bound, inc, log_w): weights of the cells above each bound sum to 1.

    With ``truncation="joint"`` the weights of all cells do, also of those not above the bound.
    At most scenarios x cap x cells rows, whatever the number of persons.
    """
    cells = cell_count(step, cap)
    priors = F.array(
        *[F.struct(F.lit(s.name).alias("scenario"), F.lit(s.mu).alias("mu"), F.lit(s.sd).alias("sd")) for s in scenarios]
    )
    raw = (
        bounds.select("inc_lower_bound")
        .where(F.col("inc_lower_bound").between(0, cap - 1))
        .distinct()
        .select("inc_lower_bound", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
        .select("inc_lower_bound", ((F.col("cell") + 0.5) * step).alias("inc"))
        .where(F.lit(truncation == "joint") | (F.col("inc") > F.col("inc_lower_bound")))
        .select("*", F.inline(priors))
        .withColumn("log_k", lognormal_log_kernel(F.col("inc"), F.col("mu"), F.col("sd")))
    )
    group = Window.partitionBy("scenario", "inc_lower_bound")
    top = F.max("log_k").over(group)
    return (
        raw.withColumn("top", top)
        .withColumn("total", F.sum(F.exp(F.col("log_k") - F.col("top"))).over(group))
        .where(F.col("inc") > F.col("inc_lower_bound"))
        .select(
            "scenario",
            "inc_lower_bound",
            "inc",
            (F.col("log_k") - F.col("top") - F.log("total")).alias("log_w"),
        )
    )
