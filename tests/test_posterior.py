import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from onsetlens.operators import posterior
from onsetlens.operators.posterior import posterior_weights, resample_copies, resample_draws
from onsetlens.operators.summaries import curve_summary, empirical_curve, parameter_summary
from onsetlens.operators.model import curve

PARAMS = "cohort string, param_id long, beta1 double, beta2 double, beta3 double, cutpoint double"
SCORES = PARAMS + ", loglik double, logprior double, logproposal double"


def scored(spark, rows):
    return spark.createDataFrame([(c, i, 0.1 * i, -0.1, -0.01, 4.0, *s) for c, i, *s in rows], SCORES)


def test_weights(spark):
    rows = [("a", 0, -1e5, 0.0, 0.0), ("a", 1, -1e5 + math.log(3), 1.0, 1.0), ("b", 0, 2.0, 0.0, 0.0)]
    found = {(r.cohort, r.param_id): (r.weight, r.ess) for r in posterior_weights(scored(spark, rows)).collect()}
    assert found["a", 0] == pytest.approx((0.25, 1.6)) and found["a", 1] == pytest.approx((0.75, 1.6))
    assert found["b", 0] == (1.0, 1.0)


def test_weights_of_impossible_rows(spark):
    low = float("-inf")
    rows = [("a", 0, low, 0.0, 0.0), ("a", 1, 0.0, low, 0.0), ("b", 0, low, 0.0, 0.0), ("b", 1, 5.0, 0.0, 0.0), ("b", 2, float("nan"), 0.0, 0.0)]
    found = {(r.cohort, r.param_id): (r.weight, r.ess) for r in posterior_weights(scored(spark, rows)).collect()}
    assert found["a", 0] == (0, 0) and found["a", 1] == (0, 0)
    assert found["b", 0][0] == 0 and found["b", 1] == (1, 1) and found["b", 2][0] == 0


@pytest.mark.parametrize("bucket", [4096, 7, 1])
def test_systematic_resampling(spark, monkeypatch, bucket):
    monkeypatch.setattr(posterior, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    weight = rng.random(50) ** 4
    weight /= weight.sum()
    rows = [(c, i, float(i), -1.0, -1.0, 1.0, float(w)) for c in "ab" for i, w in enumerate(weight)]
    weights = spark.createDataFrame(rows, PARAMS + ", weight double").repartition(5)
    n, u0 = 400, 0.37
    points = np.searchsorted(np.cumsum(weight), (np.arange(n) + u0) / n)
    expected = {i: int((points == i).sum()) for i in set(points)}
    copies = resample_copies(weights, n, u0).where("cohort = 'a'").collect()
    assert {r.param_id: r.copies for r in copies} == expected
    draws = resample_draws(weights, n, u0).where("cohort = 'b'").orderBy("draw").collect()
    assert [r.draw for r in draws] == list(range(n)) and [r.param_id for r in draws] == list(points)


def test_one_row_takes_all_draws(spark):
    rows = [("a", 0, 0.0, -1.0, -1.0, 1.0, 0.0), ("a", 1, 1.0, -1.0, -1.0, 1.0, 1.0)]
    weights = spark.createDataFrame(rows, PARAMS + ", weight double")
    assert [(r.param_id, r.copies) for r in resample_copies(weights, 28_000).collect()] == [(1, 28_000)]


def test_copies_count_like_repeated_draws(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, *map(float, (rng.normal(), -rng.random(), -rng.random() / 50, 8 * rng.random())), int(c)) for i, c in enumerate(rng.integers(1, 9, 40))]
    copies = spark.createDataFrame(rows, PARAMS + ", copies long")
    repeated = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    for summary, key in ((lambda d: parameter_summary(d), "Parameter"), (lambda d: curve_summary(curve(d, 60)), "days_since_infection")):
        a, b = (summary(d).orderBy(key).toPandas() for d in (copies, repeated))
        assert list(a[key]) == list(b[key])
        for name in a.columns.difference(["cohort", key]):
            assert np.allclose(a[name], b[name], atol=1e-12)


def test_parameter_summary_is_the_usual_quantile(spark):
    rows = [("a", i, float(i), -float(i), -1.0, 2.0 * i, 5.0 + i) for i in range(1, 12)]
    found = {r.Parameter: r for r in parameter_summary(spark.createDataFrame(rows, PARAMS + ", inc1 double")).collect()}
    assert set(found) == {"Cutpoint", "Beta1", "Beta2", "Beta3", "Inc1"}
    values = np.arange(1, 12)
    assert found["Beta1"].CI95Low == pytest.approx(np.quantile(values, 0.025))
    assert found["Inc1"].CI95Up == pytest.approx(np.quantile(values + 5, 0.975))
    assert found["Cutpoint"].median == 12 and found["Cutpoint"].mean == pytest.approx(12)


def test_empirical_curve_by_hand(spark):
    counts = spark.createDataFrame(
        [("a", 1, 3, 1, 2), ("a", 2, 3, 1, 1), ("a", 3, 4, 0, 5), ("a", 3, -1, 5, 5)],
        "cohort string, draw long, x int, pos long, n long",
    )
    found = {r.x: r for r in empirical_curve(counts).collect()}
    assert set(found) == {3, 4}
    assert (found[3].mean, found[3].top, found[3].bottom) == pytest.approx((0.75, 0.9875, 0.5125))
    assert found[4].mean == 0


def test_the_day_filter_runs_below_the_aggregate(spark):
    counts = spark.createDataFrame([("a", 1, 3, 1, 2)], "cohort string, draw long, x int, pos long, n long")
    plan = empirical_curve(counts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
