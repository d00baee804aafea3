from onsetlens.operators.panels import panels
from onsetlens.operators.reshape import to_long, to_wide, transpose


def test_panels(spark):
    curves = spark.createDataFrame(
        [("Maori", 0.1, 0.5, 0.4, 0.6), ("Other", 0.1, 0.7, 0.6, 0.8), ("AllTests", 0.1, 0.7, 0.6, 0.8)],
        "cohort string, days_since_infection double, median double, lower_95 double, upper_95 double",
    )
    empirical = spark.createDataFrame([("Other", 3, 0.9, 0.5, 0.1)], "cohort string, x int, top double, mean double, bottom double")
    rows = sorted(tuple(r) for r in panels(curves, empirical, only="F").collect())
    assert rows == [
        ("F", "Maori", 1, "curve", 0.1, 0.5, 0.6, 0.4),
        ("F", "non-Maori & non-Pacific", 3, "curve", 0.1, 0.7, 0.8, 0.6),
        ("F", "non-Maori & non-Pacific", 3, "empirical", 3.0, 0.5, 0.9, 0.1),
    ]
    assert panels(curves, empirical).count() == 4


def test_wide_long_transpose(spark):
    wide = spark.createDataFrame([("r1", 1.0, 2.0, 3.0), ("r2", 4.0, 5.0, None)], "row string, a double, b double, c double")
    long = to_long(wide, ["row"])
    assert long.count() == 6
    assert sorted(map(tuple, to_wide(long, "row", "column", "value", ["a", "b", "c"]).collect()))[0] == ("r1", 1.0, 2.0, 3.0)
    turned = transpose(wide, "row", ["r1", "r2"])
    assert turned.columns == ["column", "r1", "r2"]
    assert sorted(map(tuple, turned.collect())) == [("a", 1.0, 4.0), ("b", 2.0, 5.0), ("c", 3.0, None)]
