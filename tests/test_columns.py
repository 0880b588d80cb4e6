from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracklane.config import SETTINGS
from tracklane.functions import columns as C
from tracklane.sources.csv_files import snake_case


def evaluate(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_dots_points(spark):
    rows = [("M", 83.0, 700.0), ("M", 100.0, 600.0), ("F", 63.0, 400.0), ("F", 75.0, 500.0), ("Mx", 75.0, 500.0), ("M", None, 1.0)]
    got = evaluate(spark, rows, "sex string, bw double, total double", C.dots("sex", "bw", "total"))
    assert got[:4] == pytest.approx([472.56, 369.31, 430.21, 486.99], abs=0.01)
    assert got[4:] == [None, None]


def test_tier_bounds_are_half_open(spark):
    rows = [(0.0,), (199.99,), (200.0,), (300.0,), (400.0,), (500.0,), (999.0,), (None,)]
    assert evaluate(spark, rows, "score double", C.tier("score")) == [0, 0, 1, 2, 3, 4, 4, None]
    names = evaluate(spark, rows, "score double", C.tier_name(C.tier("score")))
    assert names == ["Beginner", "Beginner", "Intermediate", "Advanced", "Elite", "World Class", "World Class", None]


def test_weight_class_bounds(spark):
    rows = [
        ("M", 59.0, "59"),
        ("M", 59.1, "66"),
        ("M", 120.0, "120"),
        ("M", 120.1, "120+"),
        ("F", 84.1, "84+"),
        ("Mx", 60.0, "66"),
        (None, 60.0, "unknown"),
        ("M", None, "unknown"),
        ("X", 60.0, "unknown"),
    ]
    got = evaluate(spark, rows, "sex string, bw double, expected string", C.weight_class("sex", "bw"))
    assert got == [r[2] for r in rows]


def test_meet_type(spark):
    rows = [("international open", 2), ("world cup", 1), ("commonwealth", 1), ("state titles", 3), ("club day", 4), (None, 4)]
    assert evaluate(spark, rows, "name string, expected int", C.meet_type("name")) == [r[1] for r in rows]


def test_entity_key(spark):
    rows = [("Ann Lee Smith", "F", 1990), ("Bo", "Mx", 1985), ("Cy Day", "M", None), (None, "M", 1990)]
    got = evaluate(spark, rows, "name string, sex string, born int", C.entity_key("name", "sex", "born"))
    assert got == ["ann-lee smith-f-1990", "bo-mx-1985", None, None]


def test_half_year_age(spark):
    assert evaluate(spark, [(30.0,), (30.5,), (None,)], "age double", C.half_year_age("age")) == [30.5, 30.5, None]


def test_pct_change_needs_a_positive_previous_value(spark):
    rows = [(300.0, 0.0), (300.0, 200.0), (300.0, None)]
    assert evaluate(spark, rows, "cur double, prev double", C.pct_change("cur", "prev")) == [None, 50.0, None]


def test_ratio_by_zero_is_null(spark):
    assert evaluate(spark, [(1.0, 0.0), (1.0, 4.0)], "a double, b double", C.ratio("a", "b")) == [None, 0.25]


def test_buckets_are_right_closed(spark):
    rows = [(1,), (3,), (4,), (8,), (9,), (15,), (16,)]
    labels = SETTINGS.experience_labels
    got = evaluate(spark, rows, "n int", C.experience_level("n"))
    assert got == [labels[0], labels[0], labels[1], labels[1], labels[2], labels[2], labels[3]]
    days = [(0,), (180,), (181,), (3650,), (3651,)]
    assert evaluate(spark, days, "d int", C.tenure_bucket("d")) == ["0-6mo", "0-6mo", "6-12mo", "7-10yr", "10yr+"]
    assert evaluate(spark, days, "d int", C.tenure_order("d")) == [0, 0, 1, 6, 7]
    gaps = [(0,), (90,), (91,), (365,), (366,), (None,)]
    assert evaluate(spark, gaps, "d int", C.gap_category("d")) == [1, 1, 2, 2, 3, 3]


def test_strict_lookup_raises_on_an_unknown_value(spark):
    lookup = C.strict_lookup("sex", SETTINGS.sex_code, "sex")
    assert evaluate(spark, [("M",), ("Mx",), (None,)], "sex string", lookup) == [1, 0, None]
    with pytest.raises(PySparkException, match="unmapped sex: Q"):
        evaluate(spark, [("Q",)], "sex string", lookup)


def test_weight_class_number(spark):
    rows = [("83",), ("120+",), ("unknown",)]
    assert evaluate(spark, rows, "c string", C.weight_class_number("c")) == [83.0, 120.0, 0.0]


def test_mean_and_std_of_present_values(spark):
    rows = [(1.0, 2.0, 6.0), (1.0, None, 3.0), (None, None, 3.0)]
    cols = [F.col(c) for c in "abc"]
    schema = "a double, b double, c double"
    assert evaluate(spark, rows, schema, C.mean_of(cols, 2)) == [3.0, 2.0, None]
    assert evaluate(spark, rows, schema, C.std_of(cols, 2)) == [pytest.approx(math.sqrt(7)), pytest.approx(math.sqrt(2)), None]


def test_snake_case():
    assert snake_case("Best3SquatKg") == "best3_squat_kg"
    assert snake_case("MeetName") == "meet_name"
    assert snake_case("Sex") == "sex"
