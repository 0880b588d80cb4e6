from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tracklane.operators import clean, identity
from tracklane.plans.raw import raw_results
from tracklane.sources.schemas import LANDING


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_numeric_place(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "DQ"), ("c", "G"), ("d", None), ("e", "12"), ("f", "1a")], "name string, place string")
    assert names(clean.numeric_place(df)) == ["a", "e"]


def test_quality_rules(spark):
    schema = "name string, sex string, bodyweight double, squat double, bench double, deadlift double, total double"
    rows = [
        ("clean", "M", 80.0, 200.0, 150.0, 250.0, 600.0),
        ("zero squat", "M", 80.0, 0.0, 150.0, 250.0, 400.0),
        ("negative squat", "M", 80.0, -1.0, 150.0, 250.0, 399.0),
        ("no bench", "M", 80.0, 200.0, None, 250.0, 450.0),
        ("off by 2", "M", 80.0, 200.0, 150.0, 250.0, 598.0),
        ("off by 2.5", "M", 80.0, 200.0, 150.0, 250.0, 597.5),
        ("off by 2.6", "M", 80.0, 200.0, 150.0, 250.0, 597.4),
        ("light", "M", 35.0, 200.0, 150.0, 250.0, 600.0),
        ("heaviest", "M", 210.0, 200.0, 150.0, 250.0, 600.0),
        ("heavy f", "F", 160.0, 200.0, 150.0, 250.0, 600.0),
        ("limit f", "F", 150.0, 200.0, 150.0, 250.0, 600.0),
        ("mx", "Mx", 80.0, 200.0, 150.0, 250.0, 600.0),
        ("no sex", None, 80.0, 200.0, 150.0, 250.0, 600.0),
    ]
    df = spark.createDataFrame(rows, schema)
    rules = clean.quality_rules()
    assert names(clean.apply_rules(df, rules)) == ["clean", "heaviest", "limit f", "off by 2", "off by 2.5"]
    report = {r.rule: (r.rows_before, r.rows_dropped) for r in clean.drop_report(df, rules).collect()}
    assert report == {"bombout": (13, 3), "total_consistency": (10, 1), "bodyweight": (9, 4)}


def test_guard_keeps_unknown_gaps(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 29, 5.0), (3, 30, 5.0), (4, None, 5.0)], "i int, gap int, rate double")
    got = clean.guard_short_gaps(df, ["rate"], "gap").orderBy("i").collect()
    assert [r.rate for r in got] == [None, None, 5.0, 5.0]


def test_birth_year_window_cancels(spark):
    df = spark.createDataFrame([(date(2020, 5, 1), 30.0), (date(2020, 5, 1), 30.5), (date(2020, 5, 1), None)], "date date, age double")
    got = [(r.min_birth_year, r.max_birth_year, r.birth_year) for r in identity.add_birth_year(df).collect()]
    assert got == [(1987.5, 1991.5, 1989), (1987.5, 1991.5, 1989), (None, None, None)]


def test_one_row_per_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("a", "x", 3), (None, None, 9), (None, None, 8)], "k string, m string, v int")
    got = sorted((r.k or "", r.m or "", r.v) for r in identity.one_row_per(df, ["k", "m"], ["v"]).collect())
    assert got == [("", "", 8), ("a", "", 1), ("a", "x", 3)]


def test_copies_are_limited_before_the_exchange(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = identity.one_row_per(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan.index("WindowGroupLimit", plan.index("Exchange"))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < before_exchange


def test_raw_keeps_the_earliest_country_and_one_row_per_meet(spark):
    base = dict.fromkeys(LANDING.names)
    rows = [
        {**base, "name": "Ann Lee Smith", "sex": "F", "age": 30.0, "date": "2020-05-01", "meet_name": "Open", "meet_country": "B", "place": "1", "total_kg": 1.0},
        {**base, "name": "Ann Lee Smith", "sex": "F", "age": 29.0, "date": "2019-05-01", "meet_name": "Cup", "meet_country": "A", "place": "2", "total_kg": 2.0},
        {**base, "name": "Ann Lee Smith", "sex": "F", "age": 29.5, "date": "2019-05-01", "meet_name": "CUP", "meet_country": "C", "place": "3", "total_kg": 3.0},
        {**base, "name": "Ann Lee Smith", "sex": "F", "age": 30.0, "date": "2018-05-01", "meet_name": "Old", "meet_country": "D", "place": "DQ"},
        {**base, "name": "No Age", "sex": "F", "date": "2018-05-01", "meet_name": "Old", "meet_country": "D", "place": "1"},
    ]
    df = spark.createDataFrame([tuple(r[c] for c in LANDING.names) for r in rows], LANDING)
    got = raw_results(df).orderBy("date").collect()
    assert [(r.primary_key, r.meet_name, r.origin_country) for r in got] == [
        (None, "old", None),
        ("ann-lee smith-f-1989", "cup", "A"),
        ("ann-lee smith-f-1989", "open", "A"),
    ]


def namesake_rows(spark, people):
    rows = [(key, name, born) for key, name, born, n in people for _ in range(n)]
    return spark.createDataFrame(rows, "primary_key string, name string, birth_year int")


def test_namesakes(spark):
    people = [
        ("a1", "Al Day", 1990, 5),
        ("a2", "AL DAY", 1992, 3),  # near, fewer rows: dropped
        ("b1", "Bo Day", 1990, 4),
        ("b2", "Bo Day", 1991, 4),  # tie: both stay
        ("c1", "Cy Day", 1990, 5),
        ("c2", "Cy Day", 1994, 3),  # too far apart
        ("d1", "Di Day", 1990, 3),
        ("d2", "Di Day", 1993, 4),  # chain: d1 < d2 < d3
        ("d3", "Di Day", 1996, 5),
        ("e1", "Ed Day", None, 3),
    ]
    df = namesake_rows(spark, people)
    keys = sorted(r.primary_key for r in identity.drop_namesakes(df).select("primary_key").distinct().collect())
    assert keys == ["a1", "b1", "b2", "c1", "c2", "d3", "e1"]
    both = identity.keep_active(identity.drop_namesakes(df))
    assert sorted(map(tuple, identity.resolve_entities(df).collect()), key=str) == sorted(map(tuple, both.collect()), key=str)


def test_keep_active_drops_short_and_unknown_entities(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)] * 5, "primary_key string")
    assert {r.primary_key for r in identity.keep_active(df).collect()} == {"a"}


def test_join_invariant_reports_repeated_keys(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    lookup = spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    got = {r.metric: r.value for r in identity.join_invariant(left, lookup, "k").collect()}
    assert got == {"rows_before": 2, "rows_after": 3, "repeated_keys": 1}
    unique = lookup.filter(F.col("w") == 1)
    assert {r.value for r in identity.join_invariant(left, unique, "k").collect()} == {2, 0}


def test_rows_alone_under_their_keys_are_not_exchanged(spark, monkeypatch):
    rows = [("a", "x", 2), ("a", "x", 1), ("b", None, 3), ("b", None, 3), (None, "y", 5), ("c", "y", 4), (None, None, None)]
    df = spark.createDataFrame(rows, "k string, m string, v int")
    want = sorted(identity.one_row_per(df, ["k", "m"], ["v"]).collect(), key=str)
    rare = identity.one_row_per_rare(df, ["k", "m"], ["v"])
    assert sorted(rare.collect(), key=str) == want and rare.columns == df.columns
    logical = rare._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in logical and logical.index("LeftAnti") < logical.index("Window")
    monkeypatch.setattr(identity, "REPEATED_KEYS", 1)  # too many to tell: all rows go one way
    plain = identity.one_row_per_rare(df, ["k", "m"], ["v"])
    assert "Union" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(plain.collect(), key=str) == want


def test_raw_results_sort_only_repeated_rows(spark):
    base = {**dict.fromkeys(LANDING.names), "date": "2020-01-01", "age": 30.0, "place": "1"}
    rows = [tuple({**base, "meet_name": m}[c] for c in LANDING.names) for m in ("X", "Y", "Y")]
    raw = raw_results(spark.createDataFrame(rows, LANDING))
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert raw.count() == 2 and "Union" in plan and "LeftAnti" in plan
