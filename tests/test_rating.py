"""The rounds against a plain loop that updates field by field."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tracklane.operators import rating
from tracklane.operators.rating import contest_levels, field_rating, meet_rating

SCHEMA = "primary_key string, meet_name string, date date, sex string, wc string, total double, meet_type int"
WEIGHT = {1: 1.5, 2: 1.0, 3: 0.8, 4: 0.6}


def loop(rows):
    """Meet by meet in date order; (key, meet, date, wc) -> (before, change, field mean)."""
    ratings, out = {}, {}
    meets = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        meets.setdefault((r[2], r[1]), []).append(r)
    for meet in sorted(meets):
        fields = {}
        for r in meets[meet]:
            fields.setdefault((r[3], r[4]), []).append(r)
        for _, field in sorted(fields.items()):
            before = [ratings.get(r[0], 1500.0) for r in field]
            mean = sum(before) / len(before)
            ranked = sorted(zip(field, before), key=lambda fb: fb[0][5] or 0.0)
            for position, (r, pre) in enumerate(ranked):
                if len(field) == 1:
                    out[r[0], r[1], r[2], r[4]] = (pre, None, pre)
                    continue
                expected = 1 / (1 + 10 ** ((mean - pre) / 400))
                change = 32 * WEIGHT.get(r[6], 0.6) * (position / (len(field) - 1) - expected)
                out[r[0], r[1], r[2], r[4]] = (pre, change, mean)
                ratings[r[0]] = pre + change
    return out


def rate(spark, rows, period="meet"):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    contest = {
        "entity": "primary_key",
        "date": "date",
        "field": ["meet_name", "date", "sex", "wc"],
        "measure": "total",
        "tie": "meet_name",
        "meet_type": "meet_type",
    }
    table = spark.createDataFrame(rows, SCHEMA)
    return meet_rating(table, **contest) if period == "meet" else field_rating(table, period=period, **contest)


def contests(seed, days=6, people=14):
    """Every entity is in at most one field per day; entities change class; totals tie or are missing."""
    draw, rows = random.Random(seed), []
    for d in range(days):
        day = date(2021, 1, 1) + timedelta(days=9 * d)
        for person in draw.sample(range(people), draw.randint(3, people)):
            meet = draw.choice(["open", "cup"])
            total = draw.choice([None, 500.0, 500.0, float(draw.randint(300, 700))])
            kind = {"open": draw.choice([1, 2]), "cup": 4}[meet]
            rows.append((f"p{person:02d}", meet, day, "M", draw.choice(["83", "93"]), total, kind))
    return rows


def held(rows, got):
    """The rating against the loop, row by row; an entity has one row per contest."""
    want = loop(rows)
    by_row = {(r[0], r[1], r[2], r[5] or 0.0): r[4] for r in rows}
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault((r.primary_key, r.meet_name, r.date), []).append(r)
    for (key, meet, day), same in found.items():
        classes = sorted(c for (k, m, d, _), c in by_row.items() if (k, m, d) == (key, meet, day))
        expected = sorted(want[key, meet, day, c][0] for c in classes)
        assert sorted(r.elo_rating for r in same) == pytest.approx(expected)
        if len(same) == 1:
            before, change, mean = want[key, meet, day, classes[0]]
            assert same[0].meet_field_elo == pytest.approx(mean)
            assert same[0].elo_change == (None if change is None else pytest.approx(change))


@pytest.mark.parametrize("period", ["meet", "day"])
@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_the_loop(spark, seed, period):
    rows = contests(seed)
    held(rows, rate(spark, rows, period).collect())


def test_an_entity_in_several_contests_of_a_day_goes_through_all(spark):
    draw = random.Random(5)
    rows = [
        (f"p{person}", meet, date(2021, 1, 1) + timedelta(days=d), "M", wc, float(draw.randint(300, 700)), 2)
        for d in range(4)
        for meet in ("cup", "open")
        for wc in ("83", "93")
        for person in draw.sample(range(9), draw.randint(1, 6))
    ]
    held(rows, rate(spark, rows).collect())


def test_many_files_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(rating, "FILE_ROWS", 2)
    monkeypatch.setattr(rating, "BLOCK", 2)
    rows = contests(3)
    held(rows, rate(spark, rows).collect())
    held(rows, rate(spark, rows, "day").collect())


def test_rounds_follow_the_longest_chain_not_the_dates(spark):
    chain = [(k, k + 1) for k in range(5)] + [(0, 5), (2, 5)] + [(100 + 2 * k, 101 + 2 * k) for k in range(50)]
    levels, last = contest_levels(spark.createDataFrame(chain, "before long, contest long"))
    found = {r.contest: r.level for r in levels.collect()}
    assert last == 5 and [found[k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and found[101] == 1 and 0 not in found
    none, last = contest_levels(spark.createDataFrame([], "before long, contest long"))
    assert last == 0 and none.count() == 0


def test_a_small_round_writes_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rating, "new_path", lambda spark, label: str(tmp_path / label))
    rows = [(f"p{p:02d}", "open", date(2021, 1, d), "M", "83", float(p * d % 7), 2) for d in (1, 2, 3) for p in range(40)]
    held(rows, rate(spark, rows).collect())
    assert len(list(tmp_path.glob("rated/*/part-*"))) == 3  # one of each round


def test_null_entities_count_as_one_and_empty_tables_stay_empty(spark):
    rows = [(p, "open", date(2021, 1, d), "M", "83", t, 2) for d in (1, 2) for p, t in ((None, 100.0), ("b", 200.0))]
    got = {(r.primary_key, r.date.day): r.elo_rating for r in rate(spark, rows).collect()}
    assert got[None, 2] == pytest.approx(1484.0) and got["b", 2] == pytest.approx(1516.0)
    assert rate(spark, []).count() == 0


def test_field_of_one_changes_nothing(spark):
    rows = [("a", "open", date(2021, 1, d), "M", "83", 500.0, 1) for d in (1, 2)]
    assert [(r.elo_rating, r.elo_change, r.meet_field_elo) for r in rate(spark, rows).collect()] == [(1500.0, None, 1500.0)] * 2


def test_twice_in_one_field_keeps_the_highest_position(spark):
    day = date(2021, 1, 1)
    rows = [(p, "open", day, "M", "83", t, 2) for p, t in (("a", 100.0), ("b", 200.0), ("a", 300.0))]
    rows.append(("a", "open", date(2021, 2, 1), "M", "83", 100.0, 2))
    got = rate(spark, rows).filter("date = '2021-02-01'").first()
    assert got.elo_rating == pytest.approx(1500 + 32 * 0.5)


def test_longer_periods_rate_all_fields_from_one_start(spark):
    rows = [
        *[(p, "open", date(2021, 1, 1), "M", "83", t, 2) for p, t in (("a", 100.0), ("b", 200.0))],
        *[(p, "cup", date(2021, 1, 9), "M", "83", t, 2) for p, t in (("a", 100.0), ("b", 200.0))],
        *[(p, "end", date(2021, 2, 1), "M", "83", t, 2) for p, t in (("a", 100.0), ("b", 200.0))],
    ]
    got = {(r.primary_key, r.meet_name): r.elo_rating for r in rate(spark, rows, "month").collect()}
    assert got["a", "cup"] == 1500.0
    assert got["a", "end"] == pytest.approx(1500 - 2 * 16)
    assert got["b", "end"] == pytest.approx(1500 + 2 * 16)


def test_unknown_period(spark):
    with pytest.raises(ValueError, match="unknown period"):
        rate(spark, contests(1), "decade")


def test_a_query_and_the_fits_rate_meet_by_meet(monkeypatch):
    from tracklane.queries import all_queries, layers, modelling

    periods = []
    monkeypatch.setattr(layers, "_layer", lambda spark, sf_dir, name, build: build())
    monkeypatch.setattr(layers, "base_layer", lambda *a: None)
    monkeypatch.setattr(layers, "rating_features", lambda rows, period="meet": periods.append(period))
    monkeypatch.setattr(modelling.ML, "model_frame", lambda rows, *a: rows)
    monkeypatch.setattr(modelling.ML, "temporal_split", lambda rows: rows)
    monkeypatch.setattr(modelling.ML, "dual_target", lambda rows, *a: (rows, None))
    modelling._rated_split(None, "")
    modelling.dual_target(None, "")
    with pytest.raises(AttributeError):  # the stubbed layer has no columns
        all_queries()["rating_features_meets"](None, "")
    assert periods == ["meet"] * 3


@pytest.mark.parametrize(("rows_of_a_window", "block"), [(5, 2), (30, 16)])
def test_windows_equal_the_loop(spark, monkeypatch, rows_of_a_window, block):
    monkeypatch.setattr(rating, "_few_dates", lambda dates, rows: False)
    monkeypatch.setattr(rating, "WINDOW_ROWS", rows_of_a_window)
    monkeypatch.setattr(rating, "BLOCK", block)
    monkeypatch.setattr(rating, "ROUND_ROWS", 3)
    rows = contests(1, days=12, people=9)
    held(rows, rate(spark, rows).collect())


def test_rounds_follow_the_rows_not_the_chain(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rating, "new_path", lambda spark, label: str(tmp_path / label))
    rows = [(p, "open", date(2021, 1, 1) + timedelta(days=d), "M", "83", float(d % 7), 2) for d in range(60) for p in ("a", "b")]
    held(rows, rate(spark, rows).collect())
    assert len(list(tmp_path.glob("rated/*/part-*"))) == 1  # a chain of 60 contests in one round


def test_windows_keep_null_entities_repeats_and_contests_of_one(spark, monkeypatch):
    monkeypatch.setattr(rating, "_few_dates", lambda dates, rows: False)
    first, second, third = date(2021, 1, 1), date(2021, 2, 1), date(2021, 3, 1)
    entered = [(None, 100.0), ("b", 200.0), (None, 300.0)]
    rows = [(p, "open", first, "M", "83", t, 2) for p, t in entered] + [(p, "open", second, "M", "83", 100.0, 2) for p in (None, "b")]
    rows.append((None, "open", third, "M", "83", 100.0, 2))
    for size in (1, 2, 1000):  # both contests larger than a window, one of them, none
        monkeypatch.setattr(rating, "WINDOW_ROWS", size)
        got = {(r.primary_key, r.date): r for r in rate(spark, rows).collect()}
        assert got[None, second].elo_rating == pytest.approx(1516.0) and got["b", second].elo_rating == pytest.approx(1500.0)
        assert got[None, third].elo_rating == pytest.approx(1516.0 + got[None, second].elo_change)
        assert got[None, third].elo_change is None
