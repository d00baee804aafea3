import math

import numpy as np
import pytest

from onsetlens.operators.cohorts import COHORTS, Cohort
from onsetlens.operators.diagnostics import cohort_losses, fit_report, tail_shape
from onsetlens.operators.likelihood import infection_draws
from onsetlens.operators.model import curve
from onsetlens.operators.persons import blocks, person_entries
from onsetlens.operators.posterior import posterior_weights, resample_copies
from onsetlens.operators.summaries import curve_summary, weighted_curve_summary
from onsetlens.plans.analysis import analyse_rows
from onsetlens.plans.inputs import posterior_lattice
from onsetlens.sources.sinks import draw_buckets, read_infection_draws

WEIGHTS = "scenario string, cohort string, param_id long, weight double, ess double"


def rows_of(cohort, weights):
    weights = np.asarray(weights, float) / max(sum(weights), 1e-300)
    ess = 1 / (weights**2).sum() if weights.any() else 0.0
    return [("base", cohort, i, float(w), float(ess)) for i, w in enumerate(weights)]


def shape_by_hand(weights):
    w = np.sort(np.asarray(weights) / np.sum(weights))
    m = min(int(0.2 * len(w)), math.ceil(3 * math.sqrt(len(w))))
    x = w[-m:] - w[-m - 1]
    points = 30 + int(math.sqrt(m))
    theta = 1 / x[-1] + (1 - np.sqrt(points / (np.arange(1, points + 1) - 0.5))) / (3 * x[int(m / 4 + 0.5) - 1])
    k = np.array([np.log1p(-t * x).mean() for t in theta])
    loglik = m * (np.log(-theta / k) - k - 1)
    share = np.exp(loglik - loglik.max())
    best = (share * theta).sum() / share.sum()
    return (np.log1p(-best * x).mean() * m + 5) / (m + 10)


def test_tail_shape(spark):
    rng = np.random.default_rng(1)
    light, heavy = rng.random(1000), rng.pareto(0.8, 1000)
    rows = rows_of("light", light) + rows_of("heavy", heavy) + rows_of("equal", np.ones(100)) + rows_of("few", [1, 2, 3]) + rows_of("none", np.zeros(40))
    found = {r.cohort: r for r in tail_shape(spark.createDataFrame(rows, WEIGHTS).repartition(7)).collect()}
    assert found["light"].tail_shape == pytest.approx(shape_by_hand(light), rel=1e-9) and found["light"].tail_shape < 0.3
    assert found["heavy"].tail_shape == pytest.approx(shape_by_hand(heavy), rel=1e-9) and found["heavy"].tail_shape > 0.7
    assert found["equal"].tail_shape is None and found["few"].tail_shape is None and found["none"].tail_shape is None
    assert found["none"].possible_rows == 0 and found["few"].tail_rows == 0 and found["light"].tail_rows == 95


def test_report_names_every_declared_cohort(spark, make_tests):
    tests = make_tests(
        [
            (1, 2, True, {"gender": "Female"}),
            (1, None, True, {"gender": "Female"}),
            (2, 3, None, {"gender": "Female"}),
            (3, -30, True, {"gender": "Male"}),
            (3, 4, False, {"gender": "Male"}),
            (4, 1, True, {"gender": "Unknown"}),
        ]
    )
    cohorts = tuple(Cohort(g, {"gender": g}) for g in ("Female", "Male", "Unknown", "Nobody")) + (Cohort("All", {}),)
    losses = cohort_losses(tests, cohorts)
    counted = {r.cohort: tuple(r)[1:] for r in losses.collect()}
    assert counted["Female"] == (3, 2, 0, 2, 0, 1)
    assert counted["Male"] == (2, 0, 2, 1, 1, 0)
    assert counted["All"] == (6, 2, 2, 4, 1, 1)
    weights = spark.createDataFrame(rows_of("Female", np.arange(1, 41)) + rows_of("All", [1] + [0] * 39), WEIGHTS)
    progress = [("base", "Female", 20, 0.25, False), ("base", "All", 3, 1.0, True)]
    frame = spark.createDataFrame(progress, "scenario string, cohort string, rounds int, power double, converged boolean")
    found = {r.cohort: r for r in fit_report(losses, weights, frame, cohorts).collect()}
    assert {c: r.verdict for c, r in found.items()} == {
        "Female": "not converged",
        "Male": "no placeable person",
        "Unknown": "not fitted",
        "Nobody": "no person",
        "All": "few effective rows",
    }
    assert (found["Female"].rounds, found["Female"].power, found["Nobody"].n_tests) == (20, 0.25, 0)
    assert fit_report(losses, weights.limit(0), cohorts=COHORTS).count() == len(COHORTS)


def test_weighted_curves_are_those_of_many_copies(spark):
    rng = np.random.default_rng(2)
    rows = [("base", "a", i, *v, float(-j)) for i, (v, j) in enumerate(zip(rng.normal(size=(60, 4)).tolist(), rng.exponential(2, 60)))]
    rows = [(s, c, i, b, -abs(d) * 0.1, -abs(e) * 0.01, abs(f) + 1, w, 0.0, 0.0) for s, c, i, b, d, e, f, w in rows]
    names = "scenario string, cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double, loglik double, logprior double, logproposal double"
    weights = posterior_weights(spark.createDataFrame(rows, names)).cache()
    straight = weighted_curve_summary(weights).orderBy("days_since_infection").toPandas()
    copies = resample_copies(weights, 2_000_000).select("scenario", "cohort", "copies", "beta1", "beta2", "beta3", "cutpoint")
    resampled = curve_summary(curve(copies)).orderBy("days_since_infection").toPandas()
    assert len(straight) == 501
    for name in ("median", "lower_95", "upper_95"):
        assert (straight[name] - resampled[name]).abs().max() < 1e-6, name


@pytest.fixture(scope="module")
def analysis(spark):
    from onsetlens.operators.align import align_days
    from onsetlens.sources.tables import bind_tables

    tests = align_days(bind_tables(spark, "/root/testdata/sf0.001")).cache()
    return analyse_rows(tests, posterior_lattice(tests).cache(), draws=60, empirical_draws=60, seed=3)


def test_stored_days_are_the_sample_of_every_table(spark, analysis, tmp_path):
    stored = analysis.store(str(tmp_path / "days"))
    for name in ("parameters", "empirical"):
        fresh, read = (
            sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in getattr(a, name)().collect())
            for a in (analysis, stored)
        )
        assert fresh == read and len(fresh) > 80
    assert len(analysis.parameters().where("Parameter = 'Inc1'").collect()) == 17
    one = read_infection_draws(spark, stored.stored, [("Female", 5)])
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_buckets_are_pruned(spark, analysis, tmp_path):
    from onsetlens.operators.likelihood import packed_infection_draws
    from onsetlens.sources.sinks import write_infection_draws

    packed = blocks(analysis.persons, "num_id", 30)
    path = str(tmp_path / "many")
    write_infection_draws(packed_infection_draws(analysis.copies(4), packed, seed=3), path, buckets=4)
    person = analysis.persons.where("cohort = 'Male'").first().num_id
    found = read_infection_draws(spark, path, [("Male", person)])
    assert sum(len(r.inf_days) for r in found.collect()) == 4
    days = {r.draw: r.inf_day for r in infection_draws(analysis.copies(4), packed, seed=3).where(f"cohort = 'Male' AND num_id = {person}").collect()}
    assert {r.first + i: d for r in found.collect() for i, d in enumerate(r.inf_days)} == days
    assert len(found.inputFiles()) <= len(spark.read.parquet(path).inputFiles())
    assert draw_buckets(spark, 10**6, 28_000) > 500 and draw_buckets(spark, 10, 10) == 1


def test_first_person_does_not_depend_on_the_cap(spark, make_tests):
    """The lowest id cannot be placed: its figures are null, and no other person stands in."""
    tests = make_tests([(1, -30, True), (2, 2, True), (3, 4, False), (4, -2, True)])
    cohorts = (Cohort("a", {}),)
    rows = posterior_lattice(tests, cohorts)
    found = {r.Parameter: r for r in analyse_rows(tests, rows, cohorts, draws=20).parameters().collect()}
    assert len(found) == 5 and found["Inc1"].median is None and found["Inc1"].mean is None and found["Beta1"].median is not None
    wider = {r.Parameter: r for r in analyse_rows(tests, rows, cohorts, draws=20, cap=40).parameters().collect()}
    assert wider["Inc1"].CI95Low > 30
