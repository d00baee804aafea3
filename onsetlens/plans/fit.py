"""The posterior of the curve parameters by adaptive importance sampling.

Each round scores one table of proposals for all cohorts and scenarios in one Spark job and
moves every proposal to the weighted mean and covariance of its rows.  While few rows carry the
weight, the likelihood is tempered.  Only means and covariances return to the driver, one row
per cohort and scenario; the last round's weighted rows are the posterior.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetlens.functions.density import hash_uniform
from onsetlens.operators.cohorts import COHORTS, Cohort
from onsetlens.operators.grid import BASE, CAP, STEP, Scenario
from onsetlens.operators.likelihood import marginal_loglik
from onsetlens.operators.model import PARAMETERS, param_logprior
from onsetlens.operators.persons import SET_BLOCK_ROWS, block_tasks, blocks, cohort_blocks, of_cohorts, patterns, person_sets, set_blocks
from onsetlens.operators.posterior import posterior_weights
from onsetlens.session import checkpoint_tasks, materialise, parallel_tasks

MOST_PATTERN_ROWS = 4096  # patterns in a block of a large table
SEARCH_TASKS = 16  # for the search on single tests, whose size does not depend on the data
_DF = 4  # degrees of freedom of the multivariate t proposal
_AXES = 4
_LOG_CONSTANT = (
    math.lgamma((_DF + _AXES) / 2) - math.lgamma(_DF / 2) - _AXES / 2 * math.log(_DF * math.pi)
)

# First proposal in (beta1, log -beta2, log -beta3, log cutpoint): centre and scale.
_START = ((0.0, math.log(0.1), math.log(0.01), math.log(4.0)), (2.0, 1.5, 1.5, 0.7))


@dataclass(frozen=True)
class FitSettings:
    search_rows: int = 512  # proposals per round, cohort and scenario, on single tests
    search_share: float = 0.03  # effective share of rows that a tempered round must keep there
    rows: int = 256  # the same two on whole persons
    temper_share: float = 0.07
    final_rows: int = 2048
    max_rounds: int = 20
    enough_share: float = 0.4  # effective share that ends the adaptation
    widen: float = 1.5
    loosen: float = 2.0  # factor on the scale between single tests and whole persons
    seed: int = 1


def propose(spark: SparkSession, states: Sequence[dict], rows: int, seed: int) -> DataFrame:
    """Parameter rows with log prior and log proposal density.

    Every value is a function of (seed, cohort, scenario, param_id), so a lost task repeats it.
    """
    table = spark.createDataFrame(
        [
            (s["scenario"], s["cohort"], [float(v) for v in s["centre"]], [[float(v) for v in r] for r in s["root"]])
            for s in states
        ],
        "scenario string, cohort string, centre array<double>, root array<array<double>>",
    )
    uniform = [hash_uniform(F.lit(seed), "scenario", "cohort", "param_id", F.lit(i)).alias(f"u{i}") for i in range(6)]
    # Two normals from each pair of uniforms; the last pair gives a chi-square of 4.
    shrunk = f"sqrt({_DF} / (-2 * (ln(u4) + ln(u5))))"
    normals = [
        f"sqrt(-2 * ln(u{i - i % 2})) * {'sin' if i % 2 else 'cos'}(u{i - i % 2 + 1} * {2 * math.pi}) * {shrunk} AS z{i}"
        for i in range(_AXES)
    ]
    axes = [" + ".join([f"centre[{i}]", *[f"root[{i}][{j}] * z{j}" for j in range(i + 1)]]) for i in range(_AXES)]
    distance = " + ".join(f"z{i} * z{i}" for i in range(_AXES))
    log_det = " + ".join(f"ln(root[{i}][{i}])" for i in range(_AXES))
    density = f"{_LOG_CONSTANT} - ({log_det}) - {(_DF + _AXES) / 2} * ln(1 + ({distance}) / {_DF}) AS density"
    params = (
        table.select("*", F.explode(F.expr(f"sequence(0L, {rows - 1}L)")).alias("param_id"))
        .select("*", *uniform)
        .selectExpr("*", *normals)
        .selectExpr("scenario", "cohort", "param_id", density, *[f"{axis} AS a{i}" for i, axis in enumerate(axes)])
        .selectExpr(
            "scenario",
            "cohort",
            "param_id",
            "a0 AS beta1",
            "-exp(a1) AS beta2",
            "-exp(a2) AS beta3",
            "exp(a3) AS cutpoint",
            "density - (a1 + a2 + a3) AS logproposal",  # density of the parameters, not of their logs
        )
    )
    return param_logprior(params)


def _moments(temper_share: float, widen: float):
    """Next proposal of one cohort from its rows, whose number the settings bound."""

    def next_state(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        point = np.column_stack(
            [rows.beta1, np.log(-rows.beta2), np.log(-rows.beta3), np.log(rows.cutpoint)]
        )
        fixed, loglik = (rows.logprior - rows.logproposal).to_numpy(), rows.loglik.to_numpy()
        good = np.isfinite(fixed) & np.isfinite(loglik) & np.isfinite(point).all(axis=1)
        if not good.any():  # nothing to learn from: start again, as untempered as can be
            wide = np.diag([widen * v for v in _START[1]]).tolist()
            return pd.DataFrame(
                {"scenario": [key[0]], "cohort": [key[1]], "power": [0.0], "share": [0.0], "centre": [list(_START[0])], "root": [wide]}
            )
        point, fixed, loglik = point[good], fixed[good], loglik[good]
        powers = 2.0 ** (-np.arange(0, 28, 0.25))
        log_w = powers[:, None] * (loglik - loglik.max()) + fixed
        weight = np.exp(log_w - log_w.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        ess = 1 / (weight**2).sum(axis=1)
        kept = np.flatnonzero(ess >= temper_share * len(rows))
        chosen = kept[0] if len(kept) else int(ess.argmax())
        w = weight[chosen]
        centre = w @ point
        gap = point - centre
        cov = widen * (gap * w[:, None]).T @ gap + 1e-9 * np.eye(_AXES)
        return pd.DataFrame(
            {
                "scenario": [key[0]],
                "cohort": [key[1]],
                "power": [powers[chosen]],
                "share": [ess[chosen] / len(rows)],
                "centre": [centre.tolist()],
                "root": [np.linalg.cholesky(cov).tolist()],
            }
        )

    return next_state


_STATE = "scenario string, cohort string, power double, share double, centre array<double>, root array<array<double>>"


def pattern_blocks(persons: DataFrame, cap: int = CAP, param_rows: int = 256) -> DataFrame:
    """Everything the fit reads of the persons, written once for all rounds.

    ``persons`` is a materialised table: it is counted to choose the number of tasks, which
    follows from the parameter rows of the last round too.
    """
    return checkpoint_tasks(blocks(patterns(persons), "weight", cap, tasks=block_tasks(persons, param_rows)))


def set_pattern_blocks(
    sets: DataFrame, cohorts: Sequence[Cohort] = COHORTS, cap: int = CAP, param_rows: int = 256
) -> DataFrame:
    """``pattern_blocks`` from ``person_sets``: written once for all cohorts of a person, and fanned out as read."""
    found = materialise(patterns(sets), "patterns")
    tasks = block_tasks(of_cohorts(sets, cohorts), param_rows)
    size = pattern_block_rows(found.count(), parallel_tasks(sets.sparkSession))
    return cohort_blocks(checkpoint_tasks(set_blocks(found, "weight", cap, size, tasks)), cohorts)


def pattern_block_rows(rows: int, tasks: int) -> int:
    """Rows of a block: the chances of a block's tests are found once for all of them, so more where all tasks have many blocks."""
    return max(SET_BLOCK_ROWS, min(MOST_PATTERN_ROWS, rows // (8 * tasks)))


def single_test_blocks(prepared: DataFrame, cap: int = CAP) -> DataFrame:
    """Every test as if of a person of its own: at most days x results x bounds rows per cohort."""
    person = F.transform(
        F.arrays_zip("bound", "member", "size"),
        lambda r: F.array_repeat(F.struct(r["bound"].alias("bound"), r["member"].alias("member")), r["size"]),
    )
    tests = prepared.withColumn("person", F.flatten(person)).select(
        "cohort", F.inline(F.arrays_zip("person", "day", "pos", "n"))
    )
    counted = tests.groupBy("cohort", "person.bound", "day", "pos").agg(
        F.sum(F.col("person.member") * F.col("n")).alias("weight")
    )
    entry = F.array(F.struct("day", "pos", F.lit(1).cast("long").alias("n")))
    return checkpoint_tasks(blocks(counted.withColumn("entries", entry), "weight", cap, tasks=SEARCH_TASKS))


def fit_blocks(
    prepared: DataFrame,
    scenarios: Sequence[Scenario] = (BASE,),
    settings: FitSettings = FitSettings(),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
    trace: list | None = None,
    progress: list | None = None,
) -> DataFrame:
    """Weighted parameter rows per scenario and cohort, from ``pattern_blocks``.

    ``progress`` receives (scenario, cohort, rounds, power, converged) of the last adaptation:
    a cohort that ``max_rounds`` left tempered, or with few effective rows, has not converged.

    Most rounds only look for the region of the posterior.  They run on single tests, a table
    that does not grow with the number of persons; the likelihood itself takes over from there.
    """
    spark = prepared.sparkSession
    present = [row["cohort"] for row in prepared.select("cohort").distinct().collect()]  # declared cohorts
    if not present:
        raise ValueError("no cohort has a person whose infection day can be placed")
    states = {
        (s.name, cohort): {
            "scenario": s.name,
            "cohort": cohort,
            "centre": _START[0],
            "root": np.diag(_START[1]).tolist(),
            "power": 0.0,
        }
        for s in scenarios
        for cohort in present
    }
    key = ["scenario", "cohort"]

    def score(data, which, rows, seed, fast):
        params = propose(spark, [states[k] for k in which], rows, seed)
        carry = [*PARAMETERS, "logprior", "logproposal"]
        return marginal_loglik(
            params, data, scenarios, step, cap, truncation, fast, param_rows=rows * len(which), carry=carry
        )

    def adapt(data, stage, rows, share, enough):
        active = sorted(states)
        for state in states.values():
            state["rounds"], state["converged"] = 0, False
        for number in range(settings.max_rounds):
            if not active:
                break
            seed = settings.seed * 1000 + stage * 100 + number
            scored = score(data, active, rows, seed, fast=True)
            moments = scored.groupBy(*key).applyInPandas(_moments(share, settings.widen), _STATE)
            found = moments.collect()  # one row per cohort and scenario
            for row in found:
                done = row["power"] >= 1 and row["share"] >= enough
                states[row["scenario"], row["cohort"]] = row.asDict() | {"rounds": number + 1, "converged": done}
            if trace is not None:
                trace.append({(r["scenario"], r["cohort"]): (r["power"], r["share"]) for r in found})
            active = sorted(
                (r["scenario"], r["cohort"]) for r in found if r["power"] < 1 or r["share"] < enough
            )

    adapt(single_test_blocks(prepared, cap), 0, settings.search_rows, settings.search_share, 0.1)
    for state in states.values():
        state["root"] = [[settings.loosen * v for v in r] for r in state["root"]]
    adapt(prepared, 1, settings.rows, settings.temper_share, settings.enough_share)
    if progress is not None:
        progress += [(*k, s["rounds"], float(s["power"]), s["converged"]) for k, s in sorted(states.items())]
    final = score(prepared, sorted(states), settings.final_rows, settings.seed * 1000 + 999, fast=False)
    return posterior_weights(materialise(final, "posterior"))


def fit(
    tests: DataFrame,
    cohorts: Sequence[Cohort] = COHORTS,
    scenarios: Sequence[Scenario] = (BASE,),
    settings: FitSettings = FitSettings(),
    step: float = STEP,
    cap: int = CAP,
    truncation: str = "person",
) -> DataFrame:
    """(scenario, cohort, param_id, parameters, loglik, logprior, logproposal, weight, ess)."""
    prepared = set_pattern_blocks(materialise(person_sets(tests, cohorts), "persons"), cohorts, cap, settings.final_rows)
    return fit_blocks(prepared, scenarios, settings, step, cap, truncation)
