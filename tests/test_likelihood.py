import math

import numpy as np
import pytest

from onsetlens.operators import likelihood, model
from onsetlens.operators.cohorts import Cohort, assign_cohorts
from onsetlens.operators.grid import BASE, SCENARIOS
from onsetlens.operators.likelihood import (
    infection_day_counts,
    infection_draws,
    marginal_loglik,
    marginal_loglik_relational,
    person_uniform,
    stream_key,
)
from onsetlens.operators.persons import blocks, patterns, person_entries
from onsetlens.operators.summaries import infection_day_positivity
from onsetlens.plans.sensitivity import prior_sensitivity

PARAMS = "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double"
THETAS = [(0, 0.3, -0.05, -0.01, 4.0), (1, -0.7, -0.2, -0.002, 2.5), (300, 1.5, -0.01, -0.02, 6.0)]
EVERYONE = (Cohort("a", {}),)


def persons_data():
    rng = np.random.default_rng(5)
    rows = []
    for person in range(120):
        for _ in range(1 + rng.poisson(1.5)):
            result = None if rng.random() < 0.05 else bool(rng.random() < 0.4)
            rows.append((person, int(rng.integers(-8, 25)), result))
    rows += [(1000, d, d % 3 == 0) for d in range(-2, 20) for _ in range(30)]  # one person, very many tests
    rows += [(1001, 3, None)]  # no known result
    return rows


def log_terms(theta, tests, scenario=BASE, step=0.5, cap=30, joint=False):
    """Log weight of each cell for one person, straight from the definition."""
    _, b1, b2, b3, cut = theta
    bound = max([-d for d, r in tests if r and d < 0], default=0)
    inc = (np.arange(cap / step) + 0.5) * step
    prior = np.exp(-np.log(inc) - 0.5 * ((np.log(inc) - scenario.mu) / scenario.sd) ** 2)
    prior /= prior.sum() if joint else prior[inc > bound].sum()
    out = []
    for g, w in zip(inc, prior):
        if g <= bound:
            out.append(-math.inf)
            continue
        total = math.log(w)
        for day, result in tests:
            if result is None or (joint and day + g < 0):
                continue
            gap = day + g - cut
            eta = b1 + (b2 if gap < 0 else b3) * gap * gap
            total += -np.logaddexp(0, -eta if result else eta)
        out.append(total)
    return np.array(out)


def expected_loglik(theta, rows, **options):
    total = 0.0
    for person in {r[0] for r in rows}:
        terms = log_terms(theta, [(d, r) for p, d, r in rows if p == person], **options)
        top = terms.max()
        total += top + math.log(np.exp(terms - top).sum())
    return total


@pytest.fixture(scope="module")
def params(spark):
    return spark.createDataFrame([("a", *t) for t in THETAS] + [("other", 9, 0.0, -1.0, -1.0, 1.0)], PARAMS)


@pytest.mark.parametrize("truncation", ["person", "joint"])
@pytest.mark.parametrize("step", [0.5, 1.0])
def test_against_the_definition(spark, make_tests, params, truncation, step):
    rows = persons_data()
    packed = blocks(patterns(person_entries(make_tests(rows), EVERYONE)), "weight", 30, size=16)
    found = marginal_loglik(params, packed, step=step, truncation=truncation).collect()
    assert sorted((r.scenario, r.cohort, r.param_id) for r in found) == [("base", "a", t[0]) for t in THETAS]
    for r in found:
        theta = next(t for t in THETAS if t[0] == r.param_id)
        want = expected_loglik(theta, rows, step=step, joint=truncation == "joint")
        assert r.loglik == pytest.approx(want, rel=1e-11)


def test_salted_join_single_precision_and_partitions_agree(spark, make_tests, params, monkeypatch):
    tests = make_tests(persons_data())

    def values(size, fast=False, held=512):
        monkeypatch.setattr(likelihood, "HELD_SUMS", held)
        packed = blocks(patterns(person_entries(tests.repartition(7), EVERYONE)), "weight", 30, size=size)
        return {r.param_id: r.loglik for r in marginal_loglik(params, packed, fast=fast).collect()}

    base = values(1000)
    for other in (values(3), values(16, held=1)):
        assert other == pytest.approx(base, rel=1e-12)
    assert values(1000, fast=True) == pytest.approx(base, rel=1e-5)
    monkeypatch.setattr(model, "BROADCAST_ROWS", 0)
    assert values(8) == pytest.approx(base, rel=1e-12)


def test_patterns_count_equal_persons(make_tests):
    tests = make_tests([(1, 2, True), (2, 2, True), (3, 2, True), (3, 2, True), (4, -2, True), (4, 5, False)])
    found = patterns(person_entries(tests, EVERYONE)).collect()
    assert sorted((r.bound, r.weight, [tuple(e) for e in r.entries]) for r in found) == [
        (0, 1, [(2, 1, 2)]),
        (0, 2, [(2, 1, 1)]),
        (2, 1, [(-2, 1, 1), (5, 0, 1)]),
    ]


def test_unplaceable_persons_do_not_count(make_tests, params):
    rows = [(1, 2, True), (2, 5, False)]
    packed = blocks(patterns(person_entries(make_tests(rows + [(3, -30, True)]), EVERYONE)), "weight", 30)
    found = {r.param_id: r.loglik for r in marginal_loglik(params, packed).collect()}
    assert found[0] == pytest.approx(expected_loglik(THETAS[0], rows), rel=1e-12)


@pytest.mark.parametrize("truncation", ["person", "joint"])
def test_days_far_apart(make_tests, params, truncation):
    rows = [(1, 2, True), (1, 900_000, False), (2, -2_000_000, False), (2, 7, True)]
    packed = blocks(patterns(person_entries(make_tests(rows), EVERYONE)), "weight", 30)
    found = {r.param_id: r.loglik for r in marginal_loglik(params, packed, truncation=truncation).collect()}
    want = expected_loglik(THETAS[0], rows, joint=truncation == "joint")
    assert found[0] == pytest.approx(want, rel=1e-12)


def test_grid_refinement_changes_little(make_tests, params):
    packed = blocks(patterns(person_entries(make_tests(persons_data()[:200]), EVERYONE)), "weight", 30).cache()
    by_step = [
        {r.param_id: r.loglik for r in marginal_loglik(params, packed, step=s).collect()} for s in (1.0, 0.5, 0.25)
    ]
    for p in by_step[0]:
        coarse, middle, fine = (values[p] for values in by_step)
        assert abs(middle - fine) < abs(coarse - fine) + 1e-3
        assert middle == pytest.approx(fine, abs=0.1)


def test_scenarios(spark, make_tests, params):
    rows = persons_data()[:60]
    found = prior_sensitivity(make_tests(rows), params, cohorts=EVERYONE).where("cohort = 'a'").collect()
    assert len(found) == len(SCENARIOS) * len(THETAS)
    for r in found:
        scenario = next(s for s in SCENARIOS if s.name == r.scenario)
        theta = next(t for t in THETAS if t[0] == r.param_id)
        assert r.loglik == pytest.approx(expected_loglik(theta, rows, scenario=scenario), rel=1e-11)
    for name in {r.scenario for r in found}:
        assert sum(r.weight for r in found if r.scenario == name) == pytest.approx(1)


def test_person_uniform():
    ids = np.arange(-500, 20000)
    u = person_uniform(3, ids, 5)
    assert 0 < u.min() and u.max() < 1 and len(np.unique(u)) == len(u)
    assert abs(u.mean() - 0.5) < 0.01
    other = person_uniform(3, ids, 6)
    assert abs(np.corrcoef(u, other)[0, 1]) < 0.02 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02


def test_infection_draws_follow_the_conditional_weights(spark, make_tests):
    rows = [(1, -3, True), (1, 2, True), (2, 8, False), (2, 1, True)]
    tests = make_tests(rows)
    theta = (0, 0.3, -0.05, -0.01, 4.0)
    draws = spark.range(4000).selectExpr("'a' AS cohort", "id AS param_id").crossJoin(
        spark.createDataFrame([theta[1:]], "beta1 double, beta2 double, beta3 double, cutpoint double")
    )
    packed = blocks(person_entries(tests, EVERYONE), "num_id", 30)
    found = infection_draws(draws, packed, seed=11).toPandas()
    assert len(found) == 8000 and found.groupby(["draw", "num_id"]).size().max() == 1
    assert found[found.num_id == 1].inf_day.max() <= 27 and found.inf_day.between(0, 30).all()
    for person in (1, 2):
        terms = log_terms(theta, [(d, r) for p, d, r in rows if p == person])
        weight = np.exp(terms - terms.max())
        mean_inc = (weight * (np.arange(60) + 0.5) * 0.5).sum() / weight.sum()
        assert 30 - found[found.num_id == person].inf_day.mean() == pytest.approx(mean_inc, abs=0.15)
    again = infection_draws(draws.repartition(5), packed, seed=11).toPandas()
    key = ["draw", "num_id"]
    assert np.array_equal(found.sort_values(key).inf_day.values, again.sort_values(key).inf_day.values)


def test_counts_in_the_task_equal_the_join(spark, make_tests, params):
    tests = make_tests(persons_data())
    packed = blocks(person_entries(tests, EVERYONE), "num_id", 30, size=16)
    chosen = params.where("cohort = 'a'")
    quick = infection_day_counts(chosen, packed, seed=2)
    joined = infection_day_positivity(assign_cohorts(tests, EVERYONE), infection_draws(chosen, packed, seed=2))
    names = ["cohort", "draw", "x", "pos", "n"]
    a, b = (sorted(map(tuple, df.select(names).collect())) for df in (quick, joined))
    assert a == b and sum(r[4] for r in a) == 3 * sum(r[2] is not None for r in persons_data())


def test_tests_without_a_day_do_not_count(make_tests, params):
    rows = [(1, 2, True), (2, -3, True), (3, 4, False)]
    lone = [(3, None, False), (1, None, True), (1, 3, None)]

    def tables(given):
        entries = person_entries(make_tests(given), EVERYONE)
        loglik = marginal_loglik(params, blocks(patterns(entries), "weight", 30)).collect()
        counts = likelihood.infection_day_counts(params, blocks(entries, "num_id", 30)).collect()
        return {r.param_id: r.loglik for r in loglik}, sorted(map(tuple, counts))

    (with_lone, lone_counts), (without, counts) = tables(rows + lone), tables(rows)
    assert with_lone == pytest.approx(without, rel=1e-12)
    assert lone_counts == counts


def test_uniforms_take_the_whole_id_cohort_and_scenario():
    ids = np.arange(1000, dtype=np.int64)
    u = person_uniform(stream_key(1, "base", "a"), ids, 5)
    for other in (ids + 2147483647, ids + (1 << 40), -ids - 1):
        assert not (person_uniform(stream_key(1, "base", "a"), other, 5) == u).any()
    for key in (stream_key(2, "base", "a"), stream_key(1, "base", "b"), stream_key(1, "high", "a")):
        assert abs(np.corrcoef(person_uniform(key, ids, 5), u)[0, 1]) < 0.1
    pairs = person_uniform(7, ids[:, None], np.arange(50)[None, :])
    assert len(np.unique(pairs)) == pairs.size and abs(np.corrcoef(pairs[:, 0], pairs[:, 1])[0, 1]) < 0.1


def test_copies_are_draws_of_their_own(spark, make_tests, params, monkeypatch):
    """A row with ``copies`` gives what as many rows with the same parameters give."""
    tests = make_tests(persons_data())
    packed = blocks(person_entries(tests, EVERYONE), "num_id", 30, size=16)
    chosen = params.where("cohort = 'a'").selectExpr("*", "CASE param_id WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 10 END AS first")
    copied = chosen.selectExpr("*", "CASE param_id WHEN 0 THEN 3L WHEN 1 THEN 7L ELSE 300L END AS copies")
    single = copied.selectExpr(
        "cohort", "explode(sequence(first, first + CAST(copies AS INT) - 1)) AS draw", "beta1", "beta2", "beta3", "cutpoint"
    ).withColumnRenamed("draw", "param_id")
    key = ["draw", "num_id", "inf_day"]
    a, b = (sorted(map(tuple, infection_draws(d, packed, seed=4).select(key).collect())) for d in (copied, single))
    assert a == b and len(a) == 310 * 122
    wanted = sorted(map(tuple, infection_day_counts(single, packed, seed=4).collect()))
    monkeypatch.setattr(likelihood, "HELD_COUNTS", 10)
    assert sorted(map(tuple, infection_day_counts(copied, packed, seed=4).collect())) == wanted


@pytest.mark.parametrize("truncation", ["person", "joint"])
def test_relational_form_equals_the_kernel(spark, make_tests, params, truncation):
    rows = [*persons_data(), (2000, -30, True), (2001, -29, True), (2001, 39, False)]
    found = patterns(person_entries(make_tests(rows), EVERYONE))
    kernel = marginal_loglik(params, blocks(found, "weight", 30), truncation=truncation).collect()
    relational = {(r.scenario, r.cohort, r.param_id): r.loglik for r in marginal_loglik_relational(params, found, truncation=truncation).collect()}
    assert relational == pytest.approx({(r.scenario, r.cohort, r.param_id): r.loglik for r in kernel}, rel=1e-9)
    names = [s.name for s in SCENARIOS]
    both = params.selectExpr("*", f"explode(array('{names[1]}', '{names[3]}')) AS scenario")
    kernel = marginal_loglik(both, blocks(found, "weight", 30), SCENARIOS, truncation=truncation).collect()
    relational = {(r.scenario, r.param_id): r.loglik for r in marginal_loglik_relational(both, found, SCENARIOS, truncation=truncation).collect()}
    assert relational == pytest.approx({(r.scenario, r.param_id): r.loglik for r in kernel}, rel=1e-9) and len(relational) == 6
