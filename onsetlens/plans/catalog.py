"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from onsetlens.operators import cohorts as C
from onsetlens.operators.align import align_days
from onsetlens.operators.bounds import infection_bounds, unplaceable_persons
from onsetlens.operators.diagnostics import tail_shape
from onsetlens.operators.grid import BASE, CAP, SCENARIOS, incubation_grid
from onsetlens.operators.likelihood import (
    infection_day_counts,
    infection_draws,
    marginal_loglik,
    marginal_loglik_relational,
    packed_infection_draws,
    unpacked,
)
from onsetlens.operators.model import curve, param_logprior, test_loglik
from onsetlens.operators.panels import panels
from onsetlens.operators.persons import cohort_blocks, cohort_patterns, patterns, person_entries, person_sets, set_blocks
from onsetlens.operators.positivity import positive_counts, positivity_by_day
from onsetlens.operators.posterior import posterior_weights, resample_copies, resample_draws
from onsetlens.operators.reshape import to_long, to_wide, transpose
from onsetlens.operators.summaries import (
    curve_summary,
    empirical_curve,
    infection_day_positivity,
    parameter_summary,
)
from onsetlens.plans.analysis import analyse, analyse_rows
from onsetlens.plans.inputs import day_params, given_infection_arrays, lattice_params, posterior_lattice
from onsetlens.plans.sensitivity import prior_sensitivity
from onsetlens.session import configure, materialise, scratch_path
from onsetlens.sources.checks import check_against_dictionary, check_values
from onsetlens.sources.schema import TESTS
from onsetlens.sources.sinks import (
    read_csv,
    read_draws,
    read_infection_draws,
    write_csv,
    write_draws,
    write_infection_draws,
)
from onsetlens.sources.tables import bind_events, bind_tables
from onsetlens.sources.tests_csv import load_dictionary, load_tests, rejected_counts

Query = Callable[[SparkSession, str], DataFrame]

DRAWS_GIVEN = 20  # supplied draws of the infection day per person
RESAMPLED = 1000  # equal draws per cohort in the resampling queries
LATTICE_DRAWS = 100  # draws of every person in the empirical curve of the lattice posterior
LATTICE_START = 0.31830988  # place of the first draw between two


def _tests(spark: SparkSession, folder: str) -> DataFrame:
    return align_days(bind_tables(spark, folder))


def _lattice(tests: DataFrame) -> DataFrame:
    """Written once, as its rows are counted before they are joined."""
    return materialise(lattice_params(tests), "lattice")


def _pattern_blocks(tests: DataFrame) -> DataFrame:
    return cohort_blocks(set_blocks(materialise(patterns(person_sets(tests)), "patterns"), "weight", CAP))


def _person_blocks(tests: DataFrame) -> DataFrame:
    return cohort_blocks(set_blocks(materialise(person_sets(tests), "persons"), "num_id", CAP))


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in names})


def q_load_tests(spark, folder):
    return bind_tables(spark, folder)


def q_load_tests_csv(spark, folder):
    """The tests as a delimited file, read back with the documented schema."""
    path = scratch_path(spark, "tests")
    write_csv(bind_tables(spark, folder), path, by=None)
    return load_tests(spark, path)


def q_check_values(spark, folder):
    return check_values(bind_tables(spark, folder))


def q_align_days(spark, folder):
    return _tests(spark, folder)


def q_assign_cohorts(spark, folder):
    return C.assign_cohorts(_tests(spark, folder)).select(
        "cohort", "num_id", "days_since_onset", "pcr_result", "symp_onset_day", "day_of_test"
    )


def q_cohort_counts(spark, folder):
    return C.cohort_counts(bind_tables(spark, folder))


def q_dense_ids(spark, folder):
    return C.dense_ids(C.cohort_persons(bind_tables(spark, folder)))


def q_renumber(spark, folder):
    return C.renumber(C.assign_cohorts(bind_tables(spark, folder))).select(
        "cohort", "new_id", "days_since_onset", "pcr_result"
    )


def q_subject_onsets(spark, folder):
    return C.subject_onsets(_tests(spark, folder))


def q_infection_bounds(spark, folder):
    return infection_bounds(_tests(spark, folder))


def q_unplaceable_persons(spark, folder):
    return unplaceable_persons(infection_bounds(_tests(spark, folder)), CAP)


def q_positivity_by_day(spark, folder):
    return _rounded(positivity_by_day(_tests(spark, folder)), 7, "mean", "lower", "upper")


def q_positivity_missing_days(spark, folder):
    """The same with no day for the tests of every 97th person."""
    tests = bind_tables(spark, folder)
    day = F.when(F.col("num_id") % 97 != 0, F.col("days_since_onset"))
    tests = align_days(tests.withColumn("days_since_onset", day))
    return _rounded(positivity_by_day(tests), 7, "mean", "lower", "upper")


def q_positivity_many_tests(spark, folder):
    """The same over events, where one person has many tests; one cohort holds everything."""
    everyone = (C.Cohort("Everyone", {}),)
    return _rounded(positivity_by_day(bind_events(spark, folder), cohorts=everyone), 7, "mean", "lower", "upper")


def q_person_patterns(spark, folder):
    """Distinct patterns of the many-tests binding and of the main one, counted by their size."""
    everyone = (C.Cohort("Everyone", {}),)
    found = cohort_patterns(person_sets(_tests(spark, folder))).unionByName(
        patterns(person_entries(align_days(bind_events(spark, folder)), everyone))
    )
    return found.groupBy("cohort", "bound", F.size("entries").cast("long").alias("entries")).agg(
        F.count(F.lit(1)).alias("patterns"), F.sum("weight").alias("persons")
    )


def q_incubation_grid(spark, folder):
    grid = incubation_grid(infection_bounds(_tests(spark, folder)), SCENARIOS)
    return _rounded(grid, 9, "log_w")


def q_curve(spark, folder):
    points = curve(day_params(_tests(spark, folder)).drop("x", "n"))
    return _rounded(points, 9, "p")


def q_param_logprior(spark, folder):
    return _rounded(param_logprior(day_params(_tests(spark, folder))), 7, "logprior").select(
        "cohort", "param_id", "logprior"
    )


def q_test_loglik(spark, folder):
    tests = _tests(spark, folder)
    inf_day = (F.col("te_upper_bound") - 0.5 * (1 + F.pmod("num_id", F.lit(28)))).alias("inf_day")
    days = infection_bounds(tests, by_set=True).select(F.col("cohorts").alias("of"), "num_id", inf_day)
    # A person is met once for all its cohorts.
    met = C.counted_tests(tests, by_set=True).join(days, "num_id")
    met = met.withColumn("cohorts", F.col("cohorts").bitwiseAND(F.col("of"))).where("cohorts <> 0").drop("of")
    return _rounded(test_loglik(_lattice(tests), met), 6, "loglik")


def _lattice_loglik(spark, folder, truncation="person"):
    tests = _tests(spark, folder)
    packed = _pattern_blocks(tests)
    return marginal_loglik(_lattice(tests), packed, truncation=truncation)


def q_marginal_loglik(spark, folder):
    return _rounded(_lattice_loglik(spark, folder), 6, "loglik").drop("scenario")


def q_marginal_loglik_joint(spark, folder):
    return _rounded(_lattice_loglik(spark, folder, "joint"), 6, "loglik").drop("scenario")


def _scored(spark, folder):
    """Rows scored by the likelihood of a day's results under the share of the whole cohort."""
    rows = day_params(_tests(spark, folder))
    total = rows.groupBy("cohort").agg((F.sum("x") / F.sum("n")).alias("share"))
    loglik = F.col("x") * F.log("share") + (F.col("n") - F.col("x")) * F.log1p(-F.col("share"))
    return param_logprior(
        rows.join(F.broadcast(total), "cohort")
        .withColumn("loglik", loglik)
        .withColumn("logproposal", 0.01 * F.col("param_id"))
        .drop("share", "x", "n")
    )


def q_posterior_weights(spark, folder):
    return _rounded(posterior_weights(_scored(spark, folder)), 9, "weight", "ess").select(
        "cohort", "param_id", "weight", "ess"
    )


def q_resample_draws(spark, folder):
    draws = resample_draws(posterior_weights(_scored(spark, folder)), RESAMPLED, 0.31830988)
    return draws.select("cohort", "draw", "param_id")


def q_infection_draws(spark, folder):
    tests = _tests(spark, folder)
    packed = _person_blocks(tests)
    return _rounded(infection_draws(_lattice(tests), packed, seed=7), 6, "inf_day").drop("scenario")


def q_infection_day_counts(spark, folder):
    tests = _tests(spark, folder)
    packed = _person_blocks(tests)
    return infection_day_counts(_lattice(tests), packed, seed=7).drop("scenario")


def q_parameter_summary(spark, folder):
    names = ["median", "mean", "CI95Low", "CI95Up"]
    return _rounded(parameter_summary(day_params(_tests(spark, folder))), 9, *names)


def q_parameter_summary_resampled(spark, folder):
    copies = resample_copies(posterior_weights(_scored(spark, folder)), RESAMPLED, 0.31830988)
    return _rounded(parameter_summary(copies), 9, "median", "mean", "CI95Low", "CI95Up")


def q_curve_summary(spark, folder):
    summary = curve_summary(curve(day_params(_tests(spark, folder))))
    return _rounded(summary, 9, "median", "lower_95", "upper_95")


def _empirical(tests, cohorts=C.COHORTS):
    given = given_infection_arrays(tests, DRAWS_GIVEN, cohorts)
    return empirical_curve(infection_day_positivity(C.counted_tests(tests, cohorts), given))


def q_empirical_curve(spark, folder):
    return _rounded(_empirical(_tests(spark, folder)), 9, "top", "mean", "bottom")


def _panel(name: str) -> Query:
    members = tuple(c for c in C.COHORTS if c.panel == name)

    def query(spark, folder):
        tests = _tests(spark, folder)
        curves = curve_summary(curve(day_params(tests, members)))
        return _rounded(panels(curves, _empirical(tests, members), members), 9, "y", "top", "bottom")

    query.__doc__ = f"Curves and empirical curves of the cohorts of panel {name}."
    return query


def _wide(spark, folder):
    counts = positive_counts(_tests(spark, folder))
    names = [c.name for c in C.COHORTS]
    return to_wide(counts, "days_since_onset", "cohort", "x", names)


def q_to_long(spark, folder):
    return to_long(_wide(spark, folder), ["days_since_onset"], "cohort", "x")


def q_transpose(spark, folder):
    """Days become columns, cohorts rows; the binding has the days -10..40."""
    wide = _wide(spark, folder).withColumn(
        "day", F.concat(F.lit("d"), (F.col("days_since_onset") + 10).cast("string"))
    )
    days = [f"d{i}" for i in range(51)]
    return transpose(wide.drop("days_since_onset"), "day", days, "cohort")


def q_write_summary(spark, folder):
    """The positivity table as quoted text by cohort, read back."""
    table = q_positivity_by_day(spark, folder)
    path = scratch_path(spark, "positivity")
    write_csv(table, path)
    return read_csv(spark, path, table.schema)


def q_write_draws(spark, folder):
    """The parameter rows as Parquet by cohort, read back."""
    path = scratch_path(spark, "draws")
    write_draws(day_params(_tests(spark, folder)), path)
    return _rounded(read_draws(spark, path), 9, "beta1", "beta2", "beta3", "cutpoint")


def q_prior_sensitivity(spark, folder):
    tests = _tests(spark, folder)
    found = prior_sensitivity(tests, _lattice(tests))
    return _rounded(found, 6, "loglik").withColumn("weight", F.round("weight", 6)).select(
        "scenario", "cohort", "param_id", "loglik", "weight"
    )


def q_marginal_loglik_relational(spark, folder):
    tests = _tests(spark, folder)
    found = marginal_loglik_relational(_lattice(tests), cohort_patterns(person_sets(tests)))
    return _rounded(found, 6, "loglik").drop("scenario")


def q_write_infection_draws(spark, folder):
    """The infection days of every person as Parquet by cohort and bucket, read back."""
    tests = _tests(spark, folder)
    packed = _person_blocks(tests)
    path = scratch_path(spark, "infection-days")
    write_infection_draws(packed_infection_draws(_lattice(tests), packed, seed=7), path, buckets=5)
    return _rounded(unpacked(read_infection_draws(spark, path)), 6, "inf_day").drop("scenario")


# A data dictionary as it may stand before the data, in the forms that descriptions take.
DICTIONARY = (
    ("pcr_result", "Result of the test. True=found; False=not found."),
    ("time_period", "Period of the onset. First: before; Second: during."),
    ("immunised", "Yes: one dose or more; No: none; Unknown."),
    ("gender", "Male/Female"),
    ("age_group", "under40/over40 years old"),
    ("comorbidities", "1: at least one; 0: none"),
    ("ethnicity", "as the person says, or unknown"),
)


def _file_with_head(spark, folder):
    """Title, dictionary and tests as one folder of text; some lines have no number or no day."""
    path = scratch_path(spark, "tests-with-head")
    names = [f.name for f in TESTS.fields]
    tests = bind_tables(spark, folder)
    number = F.when(F.col("num_id") % 97 == 0, F.concat(F.lit("x"), F.col("num_id"))).otherwise(F.col("num_id").cast("string"))
    day = F.when(F.col("num_id") % 89 == 0, F.lit("soon")).otherwise(F.col("days_since_onset").cast("string"))
    fields = [{"num_id": number, "days_since_onset": day}.get(n, F.coalesce(F.col(n).cast("string"), F.lit("NA"))) for n in names]
    head = ['"Results of a study, masked",,', ",,", "Field name,Description,"]
    head += [f'{field},"{text}",' for field, text in DICTIONARY] + [",".join(names)]
    lines = spark.createDataFrame([(line,) for line in head], "value string").union(tests.select(F.concat_ws(",", *fields).alias("value")))
    lines.write.text(path)
    return path


def q_check_dictionary(spark, folder):
    """Values that the dictionary in the file's own head does not document."""
    path = _file_with_head(spark, folder)
    return check_against_dictionary(load_tests(spark, path), load_dictionary(spark, path))


def q_rejected_lines(spark, folder):
    """Lines left out and fields left empty, by reason."""
    return rejected_counts(spark, _file_with_head(spark, folder))


def _lattice_analysis(spark, folder, scenarios=(BASE,)):
    tests = _tests(spark, folder)
    rows = materialise(posterior_lattice(tests), "lattice")
    return analyse_rows(
        tests, rows, scenarios=scenarios, draws=RESAMPLED, empirical_draws=LATTICE_DRAWS, seed=7, u0=LATTICE_START
    )


def q_tail_shape(spark, folder):
    """Tail of the weights of the day rows."""
    weights = posterior_weights(_scored(spark, folder)).withColumn("scenario", F.lit(BASE.name))
    return _rounded(tail_shape(weights), 6, "ess", "tail_shape").drop("scenario")


def q_fit_report(spark, folder):
    """Counts, losses and quality of the lattice posterior, a row per declared cohort."""
    return _rounded(_lattice_analysis(spark, folder).report(), 6, "ess", "ess_share", "tail_shape")


def q_lattice_parameters(spark, folder):
    """Five parameters per cohort, the incubation period of the first person among them."""
    found = _lattice_analysis(spark, folder).parameters()
    return _rounded(found, 7, "median", "mean", "CI95Low", "CI95Up").drop("scenario")


def q_lattice_empirical(spark, folder):
    """The empirical curve over infection days drawn from the lattice posterior."""
    return _rounded(_lattice_analysis(spark, folder).empirical(), 9, "top", "mean", "bottom").drop("scenario")


def q_lattice_panels(spark, folder):
    """Curves and empirical curves of the lattice posterior, labelled by panel."""
    return _rounded(_lattice_analysis(spark, folder).panels(), 9, "y", "top", "bottom")


def q_scenario_curves(spark, folder):
    """Curve bands per incubation scenario, from the weights of the lattice."""
    return _rounded(_lattice_analysis(spark, folder, SCENARIOS).weighted_curves(), 9, "median", "lower_95", "upper_95")


def q_fit_parameters(spark, folder):
    """Posterior summary of the parameters of every cohort."""
    return analyse(_tests(spark, folder)).parameters()


def q_fit_panels(spark, folder):
    """Posterior curves and empirical curves of every cohort, labelled by panel."""
    return analyse(_tests(spark, folder)).panels()


def _configured(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark, folder):
        return query(configure(spark), folder)

    return run


_QUERIES: dict[str, Query] = {
    "load_tests": q_load_tests,
    "load_tests_csv": q_load_tests_csv,
    "check_values": q_check_values,
    "align_days": q_align_days,
    "assign_cohorts": q_assign_cohorts,
    "cohort_counts": q_cohort_counts,
    "dense_ids": q_dense_ids,
    "renumber": q_renumber,
    "subject_onsets": q_subject_onsets,
    "infection_bounds": q_infection_bounds,
    "unplaceable_persons": q_unplaceable_persons,
    "positivity_by_day": q_positivity_by_day,
    "positivity_missing_days": q_positivity_missing_days,
    "positivity_many_tests": q_positivity_many_tests,
    "person_patterns": q_person_patterns,
    "incubation_grid": q_incubation_grid,
    "curve": q_curve,
    "param_logprior": q_param_logprior,
    "test_loglik": q_test_loglik,
    "marginal_loglik": q_marginal_loglik,
    "marginal_loglik_joint": q_marginal_loglik_joint,
    "posterior_weights": q_posterior_weights,
    "resample_draws": q_resample_draws,
    "infection_draws": q_infection_draws,
    "infection_day_counts": q_infection_day_counts,
    "parameter_summary": q_parameter_summary,
    "parameter_summary_resampled": q_parameter_summary_resampled,
    "curve_summary": q_curve_summary,
    "empirical_curve": q_empirical_curve,
    **{f"panel_{name.lower()}": _panel(name) for name in ("main", "A", "B", "C", "D", "E", "F", "S")},
    "to_long": q_to_long,
    "transpose": q_transpose,
    "write_summary": q_write_summary,
    "write_draws": q_write_draws,
    "write_infection_draws": q_write_infection_draws,
    "prior_sensitivity": q_prior_sensitivity,
    "marginal_loglik_relational": q_marginal_loglik_relational,
    "check_dictionary": q_check_dictionary,
    "rejected_lines": q_rejected_lines,
    "tail_shape": q_tail_shape,
    "fit_report": q_fit_report,
    "lattice_parameters": q_lattice_parameters,
    "lattice_empirical": q_lattice_empirical,
    "lattice_panels": q_lattice_panels,
    "scenario_curves": q_scenario_curves,
    "fit_parameters": q_fit_parameters,
    "fit_panels": q_fit_panels,
}

QUERIES: dict[str, Query] = {name: _configured(query) for name, query in _QUERIES.items()}
