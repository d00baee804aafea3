"""Whole infection days are those of the exact days, whichever way they are found."""

from types import SimpleNamespace

import numpy as np
import pytest

from onsetlens.operators.grid import SCENARIOS
from onsetlens.operators.likelihood import Cells, _Sampler, _Tests
from onsetlens.plans.fit import pattern_block_rows


def block(persons, thetas, copies):
    rng = np.random.default_rng(7)
    size = rng.integers(0, 6, persons)
    tests = int(size.sum())
    given = rng.integers(1, copies, thetas)
    return SimpleNamespace(
        scenario="base", cohort="A", size_=size, day=rng.integers(-9, 41, tests), pos=rng.integers(0, 2, tests),
        n=np.ones(tests, np.int64), bound=rng.integers(0, 30, persons), member=np.arange(persons) * 7 + 1,
        copies=given, first=np.cumsum(given) - given,
        beta1=rng.normal(size=thetas), beta2=-rng.random(thetas) / 9, beta3=-rng.random(thetas) / 90, cutpoint=rng.random(thetas) * 9,
    )


@pytest.mark.parametrize("step, cap", [(0.5, 30), (0.25, 30), (1.0, 30), (0.5, 31)])
def test_equal_to_rounded_days(step, cap):
    sampler = _Sampler(Cells(SCENARIOS[:1], step, cap, "person"), block(150, 19, 300), 7)
    exact, whole = list(sampler.infection_days()), list(sampler.whole_days())
    assert [at for at, _ in exact] == [at for at, _ in whole]
    for (_, a), (_, b) in zip(exact, whole):
        assert (np.rint(a) == b).all()


def test_logs_are_laid_out_only_where_products_are_too_small():
    cells, row = Cells(SCENARIOS[:1], 0.5, 30, "person"), block(150, 19, 300)
    tests, thetas = _Tests(row), np.column_stack([row.beta1, row.beta2, row.beta3, row.cutpoint])
    laid_out = []
    cells._of_tests, whole = lambda *a: (laid_out.append(len(a)), whole(*a))[1], cells._of_tests
    chances = cells.chances(thetas, tests)
    cells.persons(row, chances, tests, 0, 150)
    assert laid_out == [4]  # the probabilities, by code
    logs = chances[0]()
    assert logs.shape == (len(tests.days), 19, 60) and np.allclose(np.exp(logs[tests.of]), chances[1])


def test_blocks_of_large_tables_hold_more_patterns():
    assert [pattern_block_rows(rows, 32) for rows in (0, 150_000, 600_000, 9_000_000)] == [1024, 1024, 2343, 4096]
