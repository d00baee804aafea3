from onsetlens.sources.checks import check_against_dictionary, check_values, dictionary_rules
from onsetlens.sources.schema import TESTS
from onsetlens.sources.sinks import read_csv, read_draws, write_csv, write_draws
from onsetlens.sources.tests_csv import load_dictionary, load_tests, rejected_counts, rejected_lines

HEADER = ",".join(TESTS.fieldNames())
PREAMBLE = (
    '"Test results of a study, with a comma, and text",,,\n,,,\n,,,\n'
    "Field name,Description,,\n"
    "num_id,Unique case ID,,\n"
    "days_since_onset,Days since onset. Negative means before.,,\n"
    '"pcr_result","True=positive, False=negative",,\n'
)
ROWS = (
    "1,-3,TRUE,Third,Include,Yes,No,Female,over40,1,Maori\n"
    "1,4,FALSE,Third,Include,Yes,No,Female,over40,1,Maori\n"
    "22,0,NA,First,Exclude,Not.applicable,NULL,Unknown,under40,0,NA\n"
)


def test_load_with_preamble(spark, tmp_path):
    path = str(tmp_path / "tests.csv")
    (tmp_path / "tests.csv").write_text(PREAMBLE + HEADER + "\n" + ROWS)
    tests = load_tests(spark, path)
    assert tests.schema == TESTS
    rows = sorted(tuple(r) for r in tests.collect() if r.pcr_result is not None)
    assert rows[0][:4] == (1, -3, True, "Third") and rows[1][:3] == (1, 4, False)
    missing = tests.where("num_id = 22").first()
    assert missing.pcr_result is None and missing.ethnicity is None and missing.overseas == "NULL"
    assert tests.count() == 3
    assert rejected_lines(spark, path).count() == 0


def test_column_order_follows_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "num_id,days_since_onset,gender,pcr_result,time_period,included_main_analysis,immunised,overseas,"
        "age_group,comorbidities,ethnicity\n5,2,Male,T,Second,Include,No,Yes,under40,0,Pacific\n"
    )
    row = load_tests(spark, str(tmp_path / "t.csv")).first()
    assert (row.num_id, row.gender, row.pcr_result, row.overseas) == (5, "Male", True, "Yes")


def test_broken_lines_are_reported(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEADER + "\n" + ROWS + "x12,3,TRUE,Third,Include,Yes,No,Male,over40,1,Other\n")
    assert load_tests(spark, str(tmp_path / "t.csv")).count() == 3
    assert rejected_lines(spark, str(tmp_path / "t.csv")).count() == 1


def test_dictionary(spark, tmp_path):
    (tmp_path / "t.csv").write_text(PREAMBLE + HEADER + "\n" + ROWS)
    found = {r.field: r.description for r in load_dictionary(spark, str(tmp_path / "t.csv")).collect()}
    assert found == {
        "num_id": "Unique case ID",
        "days_since_onset": "Days since onset. Negative means before.",
        "pcr_result": "True=positive, False=negative",
    }


def test_check_values(make_tests):
    tests = make_tests([(1, 0, None), (2, 1, True, {"time_period": "Thurs"}), (3, 1, True, {"gender": None})])
    found = {r.field: (r.rows_read, r.nulls, r.outside) for r in check_values(tests).collect()}
    assert found["pcr_result"] == (3, 1, 0)
    assert found["time_period"] == (3, 0, 1)
    assert found["gender"] == (3, 1, 0)


def test_write_and_read_back(spark, tmp_path):
    table = spark.createDataFrame(
        [('A, "b"', 1.5, 1), ("C", 0.1, 2), ("C", 1e-17, 3)], "cohort string, p double, k int"
    )
    expected = sorted(tuple(r) for r in table.collect())
    write_csv(table, str(tmp_path / "flat"), by=None)
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "flat"), table.schema).collect()) == expected
    write_csv(table, str(tmp_path / "byc"))
    back = read_csv(spark, str(tmp_path / "byc"), table.schema).select("cohort", "p", "k")
    assert sorted(tuple(r) for r in back.collect()) == expected
    write_draws(table, str(tmp_path / "draws"))
    one = read_draws(spark, str(tmp_path / "draws"), "C")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(cohort" in one._jdf.queryExecution().toString()


def test_rules_of_a_dictionary(spark, make_tests):
    rows = [
        ("pcr_result", "Test result. True=positive; False=negative."),
        ("time_period", "Time period of onset. First: 26 Feb 2020 - 14 June; Second: later; Third: 1 July."),
        ("immunised", "Yes: one dose; No: none; Not.applicable: none; Unknown."),
        ("overseas", "Yes: abroad; No: at home; Unknown/NULL: unknown."),
        ("gender", "Male/Female/Unknown"),
        ("age_group", "under40/over40 years old"),
        ("comorbidities", "1: one or more; 0: none"),
        ("ethnicity", "prioritised ethnicity: this, that, or unknown."),
        ("num_id", "Unique case ID"),
    ]
    dictionary = spark.createDataFrame(rows, "field string, description string")
    found = {}
    for r in dictionary_rules(dictionary).collect():
        found.setdefault(r.field, set()).add(r.value)
    assert found == {
        "pcr_result": {"true", "false"},
        "time_period": {"first", "second", "third"},
        "immunised": {"yes", "no", "not.applicable", "unknown"},
        "overseas": {"yes", "no", "unknown", "null"},
        "gender": {"male", "female", "unknown"},
        "age_group": {"under40", "over40"},
        "comorbidities": {"1", "0"},
    }
    tests = make_tests([(1, 0, None), (2, 1, True, {"time_period": "Thurs"}), (3, 1, True, {"gender": None})])
    checked = {r.field: tuple(r)[1:] for r in check_against_dictionary(tests, dictionary).collect()}
    assert checked["time_period"] == (3, 0, 1, 3) and checked["gender"] == (3, 1, 0, 3)
    assert checked["pcr_result"] == (3, 1, 0, 2) and checked["ethnicity"] == (3, 0, 0, 0) and "num_id" not in checked
    assert check_against_dictionary(tests, dictionary.limit(0)).collect() == []


def test_rejected_lines_by_reason(spark, tmp_path):
    broken = (
        "x12,3,TRUE,Third,Include,Yes,No,Male,over40,1,Other\n"
        "13,soon,maybe,Third,Include,Yes,No,Male,over40,1,Other\n"
        "14,NA,NA,Third,Include,Yes,No,Male,over40,many,Other\n"
    )
    (tmp_path / "t.csv").write_text(PREAMBLE + HEADER + "\n" + ROWS + broken)
    found = {r.reason: r.lines for r in rejected_counts(spark, str(tmp_path / "t.csv")).collect()}
    assert found == {
        "no number in num_id": 1,
        "unreadable days_since_onset": 1,
        "unreadable pcr_result": 1,
        "unreadable comorbidities": 1,
    }
