import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetlens.functions.density import bernoulli_logit, hash_uniform, whole_day
from onsetlens.operators import model
from onsetlens.operators.grid import SCENARIOS, cell_count, incubation_grid
from onsetlens.operators.likelihood import Cells

PARAMS = "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double"


def test_curve_at_the_cutpoint(spark):
    params = spark.createDataFrame([("a", 1, 0.0, -0.1, -0.01, 4.0), ("a", 2, 1.2, -0.1, -0.01, 7.5)], PARAMS)
    rows = {(r.param_id, r.k): r.p for r in model.curve(params).collect()}
    assert len(rows) == 2 * 501
    assert rows[1, 40] == pytest.approx(0.5)
    assert rows[2, 75] == pytest.approx(1 / (1 + math.exp(-1.2)))
    assert rows[1, 0] == pytest.approx(1 / (1 + math.exp(0.1 * 16)))
    assert rows[1, 500] == pytest.approx(1 / (1 + math.exp(0.01 * 46**2)))


def test_prior_outside_its_bounds(spark):
    rows = [("a", 1, 0.0, 0.1, -1.0, 1.0), ("a", 2, 0.0, -0.1, 0.1, 1.0), ("a", 3, 0.0, -0.1, -0.1, -1.0)]
    found = model.param_logprior(spark.createDataFrame(rows, PARAMS)).collect()
    assert all(r.logprior == float("-inf") for r in found)


def test_prior_integrates_to_one(spark):
    # Each factor separately: the density at a point over the product of the others at theirs.
    point = spark.createDataFrame([("a", 1, 1.0, -0.5, -0.25, 3.0)], PARAMS)
    normal = lambda x, m, s: -0.5 * ((x - m) / s) ** 2 - math.log(s * math.sqrt(2 * math.pi))
    upper = 0.5 * math.erfc(-1 / math.sqrt(2))
    expected = (
        normal(1, 0, 5) + normal(-0.5, 0, 1) + normal(-0.25, 0, 1) + 2 * math.log(2) + normal(3, 5, 5) - math.log(upper)
    )
    assert model.param_logprior(point).first().logprior == pytest.approx(expected, abs=1e-12)


def test_log_mass_is_stable(spark):
    rows = spark.createDataFrame([(True, 800.0), (True, -800.0), (False, 800.0), (False, 0.0)], "r boolean, e double")
    found = [r[0] for r in rows.select(bernoulli_logit(F.col("r"), F.col("e"))).collect()]
    assert found == [0.0, -800.0, -800.0, pytest.approx(math.log(0.5))]


def test_whole_days_round_half_to_even(spark):
    days = spark.createDataFrame([(24.5,), (25.5,), (25.4,), (30.5,), (31.5,)], "d double")
    x = [30 - r[0] for r in days.select(whole_day(F.col("d"))).collect()]
    assert x == [6, 4, 5, 0, -2]


def test_grid(spark):
    bounds = spark.createDataFrame([(0,), (0,), (7,), (29,), (30,)], "inc_lower_bound int")
    rows = incubation_grid(bounds, SCENARIOS).toPandas()
    assert sorted(rows.inc_lower_bound.unique()) == [0, 7, 29]
    assert set(rows.scenario) == {s.name for s in SCENARIOS}
    mass = np.exp(rows.log_w).groupby([rows.scenario, rows.inc_lower_bound]).sum()
    assert np.allclose(mass, 1)
    assert (rows.inc > rows.inc_lower_bound).all() and rows.inc.max() == 29.75
    cells = Cells(SCENARIOS, 0.5, 30, "person")
    for r in rows.itertuples():
        cell = round(r.inc / 0.5 - 0.5)
        assert cells.log_w[r.scenario][r.inc_lower_bound][cell] == pytest.approx(r.log_w, abs=1e-10)


def test_step_must_divide_a_day():
    assert cell_count(0.25, 30) == 120
    with pytest.raises(ValueError):
        cell_count(0.4, 30)


def test_uniforms(spark):
    u = np.array([r[0] for r in spark.range(20000).select(hash_uniform(F.lit(3), "id")).collect()])
    assert 0 < u.min() and u.max() < 1
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005


@pytest.mark.parametrize("limit", [500_000, 0])
def test_loglik_with_given_days(spark, make_tests, monkeypatch, limit):
    monkeypatch.setattr(model, "BROADCAST_ROWS", limit)
    tests = make_tests([(1, 2, True), (1, 2, True), (2, -3, False), (3, 0, None), (3, None, True)]).withColumns(
        {"cohort": F.lit("a"), "inf_day": F.lit(24.5)}
    )
    params = spark.createDataFrame([("a", 1, 0.3, -0.1, -0.01, 4.0), ("b", 2, 0.0, -0.1, -0.01, 4.0)], PARAMS)
    rows = model.test_loglik(params, tests).collect()
    log_p = lambda e: -math.log1p(math.exp(-e))
    late, early = 0.3 - 0.01 * (7.5 - 4) ** 2, 0.3 - 0.1 * (2.5 - 4) ** 2
    assert [(r.cohort, r.param_id) for r in rows] == [("a", 1)]
    assert rows[0].loglik == pytest.approx(2 * log_p(late) + log_p(-early))
