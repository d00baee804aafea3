from functools import reduce

import pytest
from pyspark.sql import functions as F

from onsetlens.operators import cohorts as C
from onsetlens.operators.align import align_days
from onsetlens.operators.bounds import infection_bounds, unplaceable_persons
from onsetlens.sources.tables import bind_events, bind_tables

# (tests, persons) of the binding at the smallest scale.
EXPECTED = {
    "AllTests": (4005, 989),
    "VaccinatedDelta": (780, 189),
    "UnvaccinatedDelta": (797, 206),
    "Domestic": (1729, 423),
    "Overseas": (1460, 368),
    "Female": (1424, 348),
    "Male": (1268, 322),
    "Over40": (1887, 462),
    "Under40": (2118, 527),
    "Comorb": (2008, 509),
    "NoComorb": (1997, 480),
    "Maori": (783, 191),
    "Pacific": (818, 214),
    "Other": (1448, 348),
    "PreJune20": (1995, 484),
    "June20-June21": (2072, 507),
    "PostJuly21": (1933, 482),
}


def test_counts_of_the_binding(spark, small):
    found = C.cohort_counts(bind_tables(spark, small)).collect()
    assert {r.cohort: (r.n_tests, r.n_persons) for r in found} == EXPECTED


def test_one_scan_equals_separate_filters(spark, small):
    tests = bind_tables(spark, small)
    separate = reduce(
        lambda a, b: a.unionByName(b),
        [tests.where(c.predicate()).withColumn("cohort", F.lit(c.name)) for c in C.COHORTS],
    )
    together = C.assign_cohorts(tests)
    names = together.columns
    assert together.exceptAll(separate.select(names)).count() == 0
    assert separate.select(names).exceptAll(together).count() == 0


def test_tests_are_scanned_once(spark, small):
    plan = C.assign_cohorts(bind_tables(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_unknown_values_belong_to_no_pair(make_tests):
    tests = make_tests(
        [
            (1, 0, True, {"immunised": "Not.applicable", "overseas": "NULL", "gender": "Unknown"}),
            (2, 0, True, {"overseas": None, "gender": None, "ethnicity": "unknown", "time_period": "Third"}),
        ]
    )
    found = C.assign_cohorts(tests).groupBy("num_id").agg(F.collect_set("cohort").alias("c")).collect()
    member = {r.num_id: set(r.c) for r in found}
    assert member[1] == {"AllTests", "Over40", "Comorb", "Other", "June20-June21"}
    assert member[2] == {"AllTests", "Over40", "Comorb", "PostJuly21", "VaccinatedDelta"}


@pytest.mark.parametrize("partitions", [1, 13])
def test_dense_ids(spark, small, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ids = C.dense_ids(C.assign_cohorts(bind_tables(spark, small))).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    for cohort, part in ids.groupby("cohort"):
        part = part.sort_values("num_id")
        assert part.new_id.tolist() == list(range(1, EXPECTED[cohort][1] + 1))


def test_renumber_keeps_every_test(spark, small):
    renumbered = C.renumber(C.assign_cohorts(bind_tables(spark, small)))
    assert renumbered.count() == sum(n for n, _ in EXPECTED.values())
    assert renumbered.where("new_id is null").count() == 0


def test_subject_onsets(spark, small):
    onsets = C.subject_onsets(align_days(bind_tables(spark, small)))
    assert onsets.count() == sum(p for _, p in EXPECTED.values())
    assert [r.symp_onset_day for r in onsets.select("symp_onset_day").distinct().collect()] == [30]


@pytest.mark.parametrize(
    "rows, te, inc",
    [
        ([(2, True)], 30, 0),
        ([(0, True)], 30, 0),
        ([(-3, False)], 30, 0),
        ([(-3, True), (-5, False)], 27, 3),
        ([(-3, True), (-5, True), (4, True)], 25, 5),
        ([(-4, None), (1, True)], 30, 0),
    ],
)
def test_bounds(make_tests, rows, te, inc):
    found = infection_bounds(make_tests([(1, d, r) for d, r in rows])).where("cohort = 'AllTests'").collect()
    assert [(r.te_upper_bound, r.inc_lower_bound) for r in found] == [(te, inc)]


def test_bound_uses_only_the_tests_of_the_cohort(make_tests):
    tests = make_tests([(1, -4, True, {"overseas": "Yes"}), (1, -2, True)])
    found = {r.cohort: r.inc_lower_bound for r in infection_bounds(tests).collect()}
    assert (found["AllTests"], found["Domestic"], found["Overseas"]) == (4, 2, 4)


def test_unplaceable_persons_are_reported(make_tests):
    bounds = infection_bounds(make_tests([(1, -30, True), (2, -29, True), (3, 1, False)]))
    row = unplaceable_persons(bounds, 30).where("cohort = 'AllTests'").first()
    assert (row.n_persons, row.n_unplaceable) == (3, 1)


def test_many_tests_per_person(spark, small):
    everyone = (C.Cohort("Everyone", {}),)
    row = C.cohort_counts(bind_events(spark, small), everyone).first()
    assert row.n_tests == 1000 and row.n_persons < 200
