"""The relational likelihood sums tests in columns: no lambda per cell, no row lost on any path."""

import pytest
from pyspark.sql import functions as F

from onsetlens.operators import model
from onsetlens.operators.grid import SCENARIOS
from onsetlens.operators.likelihood import marginal_loglik, marginal_loglik_relational
from onsetlens.operators.persons import blocks

ROWS = [
    ("A", 0, 3, [(-3, 0, 1), (2, 1, 2), (9, 0, 1)]),
    ("A", 0, 3, [(-3, 0, 1), (2, 1, 2), (9, 0, 1)]),  # given twice, it counts twice
    ("A", 4, 1, [(-4, 1, 1), (60, 1, 3)]),
    ("A", 0, 7, [(day, day % 2, 1 + day % 3) for day in range(40)]),
    ("A", 0, 5, []),  # has no tests
    ("A", 30, 5, [(-30, 1, 1)]),  # no cell is above the bound
    ("B", 29, 2, [(-29, 1, 1)]),
]
THETAS = [(c, i, 0.3 + i, -0.02 * (1 + i), -0.003, 4.0 + i) for c in "AB" for i in range(3)]


def logliks(df):
    return {(r["scenario"], r["cohort"], r["param_id"]): r["loglik"] for r in df.collect()}


@pytest.mark.parametrize("truncation", ["person", "joint"])
@pytest.mark.parametrize("most", [500_000, 0])
def test_equals_the_kernel(spark, monkeypatch, truncation, most):
    persons = spark.createDataFrame(ROWS, "cohort string, bound int, weight long, entries array<struct<day:int,pos:tinyint,n:long>>")
    thetas = spark.createDataFrame(THETAS, "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double")
    params = thetas.withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit(SCENARIOS[1].name))))
    filled = persons.where(F.size("entries") > 0)
    want = logliks(marginal_loglik(params, blocks(filled, "weight", 30), SCENARIOS[:2], truncation=truncation))
    monkeypatch.setattr(model, "BROADCAST_ROWS", most)
    found = marginal_loglik_relational(params, persons, SCENARIOS[:2], truncation=truncation)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert logliks(found) == pytest.approx(want, rel=1e-9)


def test_few_cells(spark):
    persons = spark.createDataFrame([("A", 0, 2, [(3, 1, 1)])], "cohort string, bound int, weight long, entries array<struct<day:int,pos:tinyint,n:long>>")
    thetas = spark.createDataFrame(THETAS, "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double")
    want = logliks(marginal_loglik(thetas, blocks(persons, "weight", 1), step=1.0, cap=1))
    assert logliks(marginal_loglik_relational(thetas, persons, step=1.0, cap=1)) == pytest.approx(want, rel=1e-9)
    empty = marginal_loglik_relational(thetas, persons.limit(0))
    assert logliks(empty) == {}
