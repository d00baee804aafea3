"""The whole analysis: fit once, then every table of the result."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from onsetlens.operators.cohorts import COHORTS, Cohort, counted_tests
from onsetlens.operators.diagnostics import cohort_losses, fit_report
from onsetlens.operators.grid import BASE, CAP, STEP, Scenario
from onsetlens.operators.likelihood import infection_day_counts, packed_infection_draws, unpacked
from onsetlens.operators.model import PARAMETERS, curve
from onsetlens.operators.panels import panels
from onsetlens.operators.persons import block_tasks, blocks, cohort_blocks, of_cohorts, person_sets, set_blocks
from onsetlens.operators.positivity import positivity_by_day
from onsetlens.operators.posterior import resample_copies, resample_draws
from onsetlens.operators.summaries import (
    curve_summary,
    empirical_curve,
    infection_day_positivity,
    parameter_summary,
    weighted_curve_summary,
)
from onsetlens.plans.fit import FitSettings, fit_blocks, set_pattern_blocks
from onsetlens.plans.sensitivity import prior_sensitivity
from onsetlens.session import materialise
from onsetlens.sources.schema import ONSET_DAY
from onsetlens.sources.sinks import (
    draw_buckets,
    read_infection_draws,
    write_csv,
    write_draws,
    write_infection_draws,
)

# Fixed value: draws kept by four chains of 8000 iterations less 1000 of warm-up.
DRAWS = 28_000


@dataclass(frozen=True)
class Analysis:
    """Tables of one fitted analysis, each a lazy DataFrame over the materialised posterior.

    Infection days are a function of (seed, scenario, cohort, person, draw).  Parameters, the
    empirical curve and the stored days therefore describe one sample, stored or not.
    """

    tests: DataFrame
    persons: DataFrame
    weights: DataFrame
    cohorts: Sequence[Cohort]
    scenarios: Sequence[Scenario]
    draws: int
    empirical_draws: int
    step: float
    cap: int
    truncation: str
    seed: int
    progress: Sequence[tuple] = field(default=(), compare=False)
    stored: str | None = None
    u0: float = 0.5
    sets: DataFrame | None = None  # ``persons`` by set of cohorts, as they are stored

    def _sampling(self) -> dict:
        return dict(
            seed=self.seed, scenarios=self.scenarios, step=self.step, cap=self.cap, truncation=self.truncation
        )

    def _blocks(self, draws: int) -> DataFrame:
        tasks = block_tasks(self.persons, draws)
        if self.sets is None:
            return blocks(self.persons, "num_id", self.cap, tasks=tasks)
        return cohort_blocks(set_blocks(self.sets, "num_id", self.cap, tasks=tasks), self.cohorts)

    def copies(self, n: int) -> DataFrame:
        """Parameter rows with the ``copies`` draws that each gives, numbered from ``first``."""
        return resample_copies(self.weights, n, self.u0)

    def equal_draws(self, n: int) -> DataFrame:
        """n draws per cohort with ``param_id`` numbering the draws."""
        drawn = resample_draws(self.weights, n, self.u0)
        return drawn.select("scenario", "cohort", F.col("draw").alias("param_id"), *PARAMETERS)

    def report(self) -> DataFrame:
        """Counts, losses, effective size, tail of the weights and a verdict per declared cohort."""
        progress = None
        if self.progress:
            schema = "scenario string, cohort string, rounds int, power double, converged boolean"
            progress = self.tests.sparkSession.createDataFrame(list(self.progress), schema)
        losses = cohort_losses(self.tests, self.cohorts, self.cap)
        return fit_report(losses, self.weights, progress, self.cohorts, self.scenarios)

    def first_incubation(self) -> DataFrame:
        """(scenario, cohort, draw, inc1): incubation period of the person with the lowest id.

        The person is the same whatever the cap; one that cannot be placed has no draws.
        """
        lowest = self.persons.groupBy("cohort").agg(
            F.min_by(F.struct("num_id", "bound", "entries"), "num_id").alias("p")
        )
        if self.stored:
            chosen = [(r["cohort"], r["num_id"]) for r in lowest.select("cohort", "p.num_id").collect()]  # declared cohorts
            days = unpacked(read_infection_draws(self.tests.sparkSession, self.stored, chosen))
        else:
            packed = blocks(lowest.select("cohort", "p.*"), "num_id", self.cap, tasks=len(self.cohorts))
            days = unpacked(packed_infection_draws(self.copies(self.draws), packed, **self._sampling()))
        return days.select("scenario", "cohort", "draw", (ONSET_DAY - F.col("inf_day")).alias("inc1"))

    def parameters(self) -> DataFrame:
        drawn = self.equal_draws(self.draws).withColumnRenamed("param_id", "draw")
        return parameter_summary(drawn.join(self.first_incubation(), ["scenario", "cohort", "draw"], "left"))

    def curves(self) -> DataFrame:
        """Resampled draws repeat parameter rows, so the curve is computed once per distinct row."""
        copies = self.copies(self.draws)
        return curve_summary(curve(copies.select("scenario", "cohort", "copies", *PARAMETERS)))

    def weighted_curves(self) -> DataFrame:
        """Curves of every scenario from the weights themselves."""
        return weighted_curve_summary(self.weights)

    def empirical(self) -> DataFrame:
        if self.stored:
            days = unpacked(read_infection_draws(self.tests.sparkSession, self.stored))
            return empirical_curve(infection_day_positivity(counted_tests(self.tests, self.cohorts), days))
        n = self.empirical_draws
        return empirical_curve(infection_day_counts(self.copies(n), self._blocks(n), **self._sampling()))

    def infection_days(self, n: int) -> DataFrame:
        """(scenario, cohort, draw, num_id, inf_day) for n draws of every person."""
        return unpacked(packed_infection_draws(self.copies(n), self._blocks(n), **self._sampling()))

    def store(self, path: str) -> Analysis:
        """Write the infection days of all ``draws`` of every person, and read them from now on.

        It takes 8 bytes per draw and person, before compression; the other tables need it not.
        """
        buckets = draw_buckets(self.tests.sparkSession, self.persons.count(), self.draws)
        packed = packed_infection_draws(self.copies(self.draws), self._blocks(self.draws), **self._sampling())
        write_infection_draws(packed, path, buckets)
        return replace(self, stored=path, empirical_draws=self.draws)

    def positivity(self) -> DataFrame:
        return positivity_by_day(self.tests, cohorts=self.cohorts)

    def panels(self, scenario: str = BASE.name) -> DataFrame:
        # Chosen before the sampling, which other scenarios would repeat.
        chosen = replace(self, weights=self.weights.where(F.col("scenario") == scenario))
        curves, empirical = (t.where(F.col("scenario") == scenario) for t in (chosen.curves(), chosen.empirical()))
        return panels(curves, empirical, self.cohorts)

    def write(self, folder: str) -> None:
        """Delimited summaries by cohort, and the posterior rows and draws as Parquet."""
        write_draws(self.weights, posixpath.join(folder, "posterior"))
        write_draws(self.equal_draws(self.draws), posixpath.join(folder, "draws"))
        for name in ("report", "parameters", "curves", "weighted_curves", "empirical", "positivity"):
            write_csv(getattr(self, name)(), posixpath.join(folder, name))


def analyse(
    tests: DataFrame,
    cohorts: Sequence[Cohort] = COHORTS,
    scenarios: Sequence[Scenario] = (BASE,),
    settings: FitSettings = FitSettings(),
    draws: int = DRAWS,
    empirical_draws: int = DRAWS,
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> Analysis:
    """Fit every cohort under every scenario.  ``tests`` are aligned.

    The empirical curve takes (empirical_draws x persons) samples; the weights of the cells are
    found once per distinct parameter row among the draws.
    """
    sets = materialise(person_sets(tests, cohorts), "persons")
    persons = of_cohorts(sets, cohorts)
    prepared = set_pattern_blocks(sets, cohorts, cap, settings.final_rows)
    progress: list[tuple] = []
    fitted = fit_blocks(prepared, scenarios, settings, step, cap, truncation, progress=progress)
    weights = materialise(fitted, "weights")
    return Analysis(
        tests, persons, weights, cohorts, scenarios, draws, empirical_draws, step, cap, truncation, settings.seed, tuple(progress), sets=sets
    )


def analyse_rows(
    tests: DataFrame,
    params: DataFrame,
    cohorts: Sequence[Cohort] = COHORTS,
    scenarios: Sequence[Scenario] = (BASE,),
    draws: int = DRAWS,
    empirical_draws: int = DRAWS,
    step: float = STEP,
    cap: int = CAP,
    seed: int = 1,
    u0: float = 0.5,
) -> Analysis:
    """The same tables for given parameter rows (cohort, param_id, parameters), such as a lattice.

    The rows stand for equal volumes of the parameters; their posterior is exact up to the grid
    of incubation periods, so nothing is proposed and nothing converges.
    """
    sets = materialise(person_sets(tests, cohorts), "persons")
    persons = of_cohorts(sets, cohorts)
    weights = materialise(prior_sensitivity(tests, params, scenarios, cohorts, step, cap, sets), "weights")
    return Analysis(
        tests, persons, weights, cohorts, scenarios, draws, empirical_draws, step, cap, "person", seed, u0=u0, sets=sets
    )
