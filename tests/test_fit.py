import numpy as np
import pandas as pd
import pytest

from onsetlens.operators.align import align_days
from onsetlens.operators.cohorts import Cohort
from onsetlens.operators.model import curve
from onsetlens.operators.persons import person_entries
from onsetlens.operators.posterior import resample_copies
from onsetlens.operators.summaries import curve_summary
from onsetlens.plans.analysis import analyse
from onsetlens.plans.fit import FitSettings, fit, fit_blocks, pattern_blocks
from onsetlens.sources.schema import TESTS

EVERYONE = (Cohort("a", {}),)
TRUE = dict(beta1=1.2, beta2=-0.12, beta3=-0.006, cutpoint=5.0)
QUICK = FitSettings(rows=256, final_rows=512)


def sensitivity(t):
    gap = t - TRUE["cutpoint"]
    return 1 / (1 + np.exp(-(TRUE["beta1"] + np.where(gap < 0, TRUE["beta2"], TRUE["beta3"]) * gap * gap)))


def simulated(persons, seed):
    rng = np.random.default_rng(seed)
    inc = rng.lognormal(1.621, 0.418, persons)
    person = np.repeat(np.arange(persons), 1 + rng.poisson(0.75, persons))
    day = np.clip(np.round(rng.normal(3, 7, len(person))), -10, 40).astype(int)
    since = day + inc[person]
    positive = (since >= 0) & (rng.random(len(person)) < sensitivity(since))
    return pd.DataFrame({"num_id": person, "days_since_onset": day, "pcr_result": positive})


@pytest.fixture(scope="module")
def tests(spark):
    table = spark.createDataFrame(simulated(30_000, 1), "num_id long, days_since_onset int, pcr_result boolean")
    return align_days(table).cache()


@pytest.fixture(scope="module")
def prepared(tests):
    return pattern_blocks(person_entries(tests, EVERYONE))


def curves(weights):
    copies = resample_copies(weights, 4000)
    return curve_summary(curve(copies)).orderBy("days_since_infection").toPandas()


@pytest.fixture(scope="module")
def joint(prepared):
    return fit_blocks(prepared, settings=QUICK, truncation="joint").cache()


def test_recovers_planted_parameters(joint):
    assert joint.first().ess > 0.3 * QUICK.final_rows
    rows = joint.toPandas()
    assert rows.weight.sum() == pytest.approx(1)
    for name, truth in TRUE.items():
        mean = (rows.weight * rows[name]).sum()
        sd = np.sqrt((rows.weight * (rows[name] - mean) ** 2).sum())
        assert abs(mean - truth) < 3.5 * sd, (name, mean, sd)
    band = curves(joint)
    inside = (band.lower_95 <= sensitivity(band.days_since_infection)) & (sensitivity(band.days_since_infection) <= band.upper_95)
    assert inside.mean() >= 0.9


def test_seed_and_step_change_little(prepared, joint):
    base = curves(joint)["median"]
    other = curves(fit_blocks(prepared, settings=FitSettings(rows=256, final_rows=512, seed=9), truncation="joint"))["median"]
    assert (base - other).abs().max() < 0.02
    finer = curves(fit_blocks(prepared, settings=QUICK, step=0.25, truncation="joint"))["median"]
    assert (base - finer).abs().max() < 0.02


def test_same_seed_repeats(spark):
    table = align_days(spark.createDataFrame(simulated(300, 3), "num_id long, days_since_onset int, pcr_result boolean"))
    small = FitSettings(search_rows=128, rows=64, final_rows=64, max_rounds=4)
    a, b = (
        fit(t, EVERYONE, settings=small).orderBy("param_id").toPandas() for t in (table, table.repartition(5, "days_since_onset"))
    )
    assert np.allclose(a.beta1, b.beta1) and np.allclose(a.weight, b.weight, atol=1e-6)


def test_whole_analysis(spark, tmp_path):
    data = simulated(400, 2)
    rng = np.random.default_rng(0)
    data["gender"] = np.where(data.num_id % 2 == 0, "Female", "Male")
    data["included_main_analysis"] = "Include"
    for name in TESTS.fieldNames():
        if name not in data:
            data[name] = 0 if name == "comorbidities" else "Unknown"
    tests = align_days(spark.createDataFrame(data[TESTS.fieldNames()], TESTS))
    settings = FitSettings(search_rows=256, rows=128, final_rows=256, max_rounds=12)
    result = analyse(tests, settings=settings, draws=500, empirical_draws=50)
    parameters = result.parameters().toPandas()
    # Cohorts without persons produce no rows, and break nothing.
    assert set(parameters.cohort) == {"AllTests", "Female", "Male", "NoComorb"}
    assert set(parameters.Parameter) == {"Cutpoint", "Beta1", "Beta2", "Beta3", "Inc1"}
    assert (parameters.CI95Low <= parameters["median"]).all() and (parameters["median"] <= parameters.CI95Up).all()
    panel = result.panels().toPandas()
    assert set(panel.panel) == {"main", "C", "E"}
    assert (panel.x >= 0).all() and (panel.series == "curve").sum() == 4 * 501
    days = result.infection_days(3)
    assert days.count() == 3 * (400 + 200 + 200 + 400)
    result.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "draws")).count() == 4 * 500
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "curves"))
    assert back.count() == 4 * 501 and "cohort" in back.columns


def test_impossible_rows_start_again():
    import pandas as pd

    from onsetlens.plans import fit as fitting

    rows = pd.DataFrame(
        {"beta1": [0.0, 1.0], "beta2": [-0.1, -0.2], "beta3": [-0.01, -0.02], "cutpoint": [4.0, 5.0]}
    ).assign(logprior=0.0, logproposal=0.0, loglik=float("-inf"))
    state = fitting._moments(0.07, 1.5)(("base", "a"), rows).iloc[0]
    assert (state.scenario, state.cohort, state.power, state.share) == ("base", "a", 0.0, 0.0)
    assert state.centre == list(fitting._START[0]) and state.root[0][0] == 1.5 * fitting._START[1][0]
