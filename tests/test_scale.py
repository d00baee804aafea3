"""What keeps tasks and shuffles small: persons fanned out late, packed draws, sized partitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetlens.operators import likelihood
from onsetlens.operators.bounds import infection_bounds
from onsetlens.operators.cohorts import Cohort, cohort_names, counted_tests
from onsetlens.operators.model import test_loglik as loglik_of_tests
from onsetlens.operators.persons import cohort_blocks, patterns, person_entries, person_sets, set_blocks
from onsetlens.operators.summaries import infection_day_positivity
from onsetlens.session import configure
from onsetlens.sources.sinks import read_infection_draws, write_infection_draws

COHORTS = (Cohort("All", {}), Cohort("Kept", {"kind": "a"}), Cohort("Rest", {"kind": "b"}))


def _tests(spark):
    rows = [(i, d, d % 2 == 0, "a" if i % 3 else "b") for i in range(40) for d in (-2 - i % 2, 1, 4)]
    rows += [(100, 1, True, "a"), (100, 2, False, "b"), (101, None, True, "a"), (None, 3, True, "b")]
    df = spark.createDataFrame(rows, "num_id long, days_since_onset int, pcr_result boolean, kind string")
    return df.select("*", F.lit(50).alias("symp_onset_day"), (F.lit(50) + F.col("days_since_onset")).alias("day_of_test"))


def test_a_person_of_several_cohorts_is_one_row_until_its_tests_differ(spark):
    sets = person_sets(_tests(spark), COHORTS)
    sizes = {r["num_id"]: r["count"] for r in sets.groupBy("num_id").count().collect()}
    assert sizes.pop(100) == 3 and set(sizes.values()) == {1} and len(sizes) == 42
    found = {(r["cohort"], r["num_id"]): [tuple(e) for e in r["entries"]] for r in person_entries(_tests(spark), COHORTS).collect()}
    assert found["All", 100] == [(1, 1, 1), (2, 0, 1)]
    assert found["Kept", 100] == [(1, 1, 1)] and found["Rest", 100] == [(2, 0, 1)]
    assert found["Kept", 101] == [] and found["Rest", None] == [(3, 1, 1)]


def test_blocks_of_sets_hold_the_persons_of_each_cohort(spark):
    sets = person_sets(_tests(spark), COHORTS)
    packed = set_blocks(sets, "num_id", 30, size=8).cache()
    assert packed.select(F.sum(F.size("rows"))).first()[0] == sets.count()
    found = cohort_blocks(packed, COHORTS).select("cohort", F.explode("member").alias("num_id"))
    wanted = person_entries(_tests(spark), COHORTS).select("cohort", "num_id")
    assert found.exceptAll(wanted).count() == 0 and wanted.exceptAll(found).count() == 0
    weights = cohort_blocks(set_blocks(patterns(sets), "weight", 30), COHORTS).select("cohort", F.explode("member").alias("w"))
    assert {r["cohort"]: r["n"] for r in weights.groupBy("cohort").agg(F.sum("w").alias("n")).collect()} == {
        r["cohort"]: r["count"] for r in wanted.groupBy("cohort").count().collect()
    }


def test_packed_draws_give_the_counts_of_single_ones(spark):
    tests = _tests(spark).where("num_id is not null").withColumn("cohort", F.lit("All"))
    packed = tests.select("cohort", "num_id").distinct().withColumn("first", F.lit(3).cast("long"))
    packed = packed.withColumn("inf_days", F.array(*[F.lit(40.2) + i * 1.4 + F.col("num_id") % 3 for i in range(4)]))
    single = likelihood.unpacked(packed.withColumn("scenario", F.lit("base"))).drop("scenario")
    found, wanted = (infection_day_positivity(tests, d) for d in (packed, single))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("kind", [np.float64, np.float32])
def test_products_and_sums_of_logs_agree(kind):
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 7, 40, 3, 2])
    n = rng.integers(1, 4, size.sum())
    n[-1] = 5000  # its product underflows
    row = type("Row", (), dict(scenario="base", size_=size, day=rng.integers(-9, 40, size.sum()), n=n, pos=rng.integers(0, 2, size.sum()), bound=np.arange(6)))
    cells = likelihood.Cells((likelihood.BASE,), 0.5, 30, "person")
    thetas = np.array([[0.3, -0.05, -0.01, 4.0], [9.0, -3.0, -2.0, 1.0]])
    tests = likelihood._Tests(row)
    _, total, scale = cells.persons(row, cells.chances(thetas, tests, kind), tests, 0, 6, kind)
    table = cells.tests(thetas, row.day, row.pos == 1) * n[:, None, None]
    of = np.repeat(np.arange(6), size)
    logs = np.stack([table[of == i].sum(axis=0) for i in tests.order]) + cells.log_w["base"][row.bound[tests.order]][:, None, :]
    wanted = np.logaddexp.reduce(logs, axis=2)
    assert np.allclose(scale + np.log(total), wanted, rtol=1e-12 if kind is np.float64 else 1e-5, atol=1e-12 if kind is np.float64 else 1e-5)


def test_partitions_follow_a_size(spark):
    configure(spark)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1024
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"


def test_bounds_by_set_are_those_of_cohorts_and_never_share_one(spark):
    tests = _tests(spark).unionByName(
        spark.createDataFrame(
            [(100, -5, True, "b"), (100, -3, None, "a"), (102, -4, True, "a"), (102, -6, True, "b")], "num_id long, days_since_onset int, pcr_result boolean, kind string"
        ).select("*", F.lit(50).alias("symp_onset_day"), (F.lit(50) + F.col("days_since_onset")).alias("day_of_test"))
    )
    sets = infection_bounds(tests, COHORTS, by_set=True)
    found = sets.select(cohort_names(COHORTS), "num_id", "te_upper_bound", "inc_lower_bound")
    wanted = infection_bounds(tests, COHORTS)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    sizes = {r["num_id"]: r["count"] for r in sets.groupBy("num_id").count().collect()}
    assert sizes.pop(100) == sizes.pop(102) == 3 and set(sizes.values()) == {1}


def test_tests_of_a_set_count_in_all_its_cohorts(spark):
    tests = _tests(spark)
    day = (F.col("te_upper_bound") - 2.5).alias("inf_day")
    single = counted_tests(tests, COHORTS).join(infection_bounds(tests, COHORTS).select("cohort", "num_id", day), ["cohort", "num_id"])
    days = infection_bounds(tests, COHORTS, by_set=True).select(F.col("cohorts").alias("of"), "num_id", day)
    met = counted_tests(tests, COHORTS, by_set=True).join(days, "num_id")
    met = met.withColumn("cohorts", F.col("cohorts").bitwiseAND(F.col("of"))).where("cohorts <> 0").drop("of")
    params = spark.createDataFrame([(c.name, i, 0.2 * i, -0.02, -0.01, 3.0) for c in COHORTS for i in range(3)], "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double")
    found, wanted = ({(r[0], r[1]): r[2] for r in loglik_of_tests(params, t, COHORTS).collect()} for t in (met, single))
    assert len(found) == 9 and found == pytest.approx(wanted)


def test_days_of_draws_leave_the_tasks_as_arrays(spark, make_tests):
    """No object per person between numpy and Spark; draws numbered with gaps start a row each."""
    tests = make_tests([(i, d, d % 3 == 0) for i in range(30) for d in (-1 - i % 3, 2, 5)])
    packed = cohort_blocks(set_blocks(person_sets(tests).cache(), "num_id", 30))
    rows = [("AllTests", i, 0.5, -0.02, -0.01, 3.0, first, n) for i, (first, n) in enumerate([(0, 3), (3, 2), (9, 2)])]
    draws = spark.createDataFrame(rows, "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double, first long, copies long")
    found = likelihood.packed_infection_draws(draws, packed, seed=5)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    days = {(r["num_id"], r["first"]): r["inf_days"] for r in found.collect()}
    assert {k: len(v) for k, v in days.items()} == {(i, f): n for i in range(30) for f, n in ((0, 5), (9, 2))}
    met = likelihood._met_with_draws(draws, packed).toPandas()
    for row in likelihood._block_rows([met]):
        sampler = likelihood._Sampler(likelihood.Cells((likelihood.BASE,), 0.5, 30, "person"), row, 5)
        for at, wanted in sampler.infection_days():
            for place, person in enumerate(sampler.num_id.tolist()):
                assert days[person, 0] + days[person, 9] == wanted[place].tolist()


@pytest.mark.parametrize("wide", [1, 10_000])
def test_distinct_numbers_are_those_of_a_sort(wide):
    code = np.random.default_rng(1).integers(-40, 40, 500) * wide
    for found, wanted in zip(likelihood._distinct(code), np.unique(code, return_inverse=True)):
        assert found.tolist() == wanted.tolist()
    assert [len(part) for part in likelihood._distinct(code[:0])] == [0, 0]


def test_files_of_infection_days_are_dealt_over_all_cores(spark, tmp_path):
    path, before = str(tmp_path / "days"), spark.conf.get("spark.sql.shuffle.partitions")
    rows = [("base", c, i, 0, [1.0, 2.0]) for c in ("A", "B", "C") for i in range(40)]
    packed = spark.createDataFrame(rows, "scenario string, cohort string, num_id long, first long, inf_days array<double>")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        write_infection_draws(packed, path, buckets=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [p.name for p in (tmp_path / "days").rglob("part-*.parquet")]
    assert len(files) == 15 and len({name.split("-")[1] for name in files}) > 5  # tasks that wrote
    assert sorted(map(tuple, read_infection_draws(spark, path).collect())) == sorted(rows)
