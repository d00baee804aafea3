import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetlens.functions.interval import beta_quantile, exact_interval
from onsetlens.operators.positivity import positivity_by_day


@pytest.mark.parametrize(
    "x, n, lower, upper",
    [(0, 20, 0.0, 0.16843347), (20, 20, 0.83156653, 1.0), (3, 10, 0.06673951, 0.65245285)],
)
def test_known_limits(spark, x, n, lower, upper):
    row = spark.createDataFrame([(x, n)], "x long, n long").select(exact_interval(F.col("x"), F.col("n")).alias("i")).first()
    assert row.i.lower == pytest.approx(lower, abs=5e-9) and row.i.upper == pytest.approx(upper, abs=5e-9)


def _tail_at_least(x, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x, n + 1))


def test_limits_solve_the_binomial_tail():
    for x, n in [(1, 2), (5, 7), (40, 90), (117, 120), (2, 300)]:
        low = beta_quantile(np.array([x]), np.array([n - x + 1]), 0.025)[0]
        high = beta_quantile(np.array([x + 1]), np.array([n - x]), 0.975)[0]
        assert _tail_at_least(x, n, low) == pytest.approx(0.025, abs=1e-10)
        assert 1 - _tail_at_least(x + 1, n, high) == pytest.approx(0.025, abs=1e-10)


def test_limits_of_huge_counts():
    n = 10**10
    x = n // 3
    low = beta_quantile(np.array([x]), np.array([n - x + 1]), 0.025)[0]
    normal = x / n - 1.959964 * math.sqrt(x / n * (1 - x / n) / n)
    assert low == pytest.approx(normal, rel=1e-8)
    assert beta_quantile(np.array([1]), np.array([n]), 0.975)[0] == pytest.approx(-math.log(0.025) / n, rel=1e-8)


def test_table(make_tests):
    tests = make_tests([(1, 2, True), (2, 2, False), (3, 2, False), (3, 2, None), (4, -1, True), (5, 9, None)])
    rows = {r.tSinceOnset: r for r in positivity_by_day(tests).where("cohort = 'AllTests'").collect()}
    assert set(rows) == {2, -1}
    assert (rows[2].method, rows[2].x, rows[2].n, rows[2].mean) == ("exact", 1, 3, pytest.approx(1 / 3))
    assert rows[-1].upper == 1.0 and rows[-1].lower == pytest.approx(0.025)
    assert rows[2].lower <= rows[2].mean <= rows[2].upper


def test_tests_without_a_day_have_no_row(make_tests):
    tests = make_tests([(1, 2, True), (2, None, False), (3, None, True)])
    rows = positivity_by_day(tests).where("cohort = 'AllTests'").collect()
    assert [(r.tSinceOnset, r.x, r.n) for r in rows] == [(2, 1, 1)]
