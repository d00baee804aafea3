"""Several incubation priors at once: the scenario is one more key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from onsetlens.operators.cohorts import COHORTS, Cohort
from onsetlens.operators.grid import CAP, SCENARIOS, STEP, Scenario
from onsetlens.operators.likelihood import marginal_loglik
from onsetlens.operators.model import param_logprior
from onsetlens.operators.persons import cohort_blocks, patterns, person_sets, set_blocks
from onsetlens.operators.posterior import posterior_weights
from onsetlens.session import materialise


def prior_sensitivity(
    tests: DataFrame,
    params: DataFrame,
    scenarios: Sequence[Scenario] = SCENARIOS,
    cohorts: Sequence[Cohort] = COHORTS,
    step: float = STEP,
    cap: int = CAP,
    persons: DataFrame | None = None,
) -> DataFrame:
    """The same parameter rows scored and weighted under each scenario, in one pass over persons.

    ``persons`` are the ``person_sets`` of the tests, where the caller has them.
    """
    found = materialise(patterns(person_sets(tests, cohorts) if persons is None else persons), "patterns")
    packed = cohort_blocks(set_blocks(found, "weight", cap), cohorts)
    names = F.array(*[F.lit(s.name) for s in scenarios])
    repeated = params.withColumn("scenario", F.explode(names))
    logliks = marginal_loglik(repeated, packed, scenarios, step, cap)
    scored = param_logprior(repeated).join(logliks, ["scenario", "cohort", "param_id"])
    # A row per scenario and parameter row; the weights read it three times.
    return posterior_weights(materialise(scored.withColumn("logproposal", F.lit(0.0)), "scenarios"))
