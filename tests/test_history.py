"""Plain windows, split entities and a loop over sorted rows must agree."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import random_panel
from pyspark.sql import functions as F

from tracklane.operators import features as P
from tracklane.operators.history import BLOCK, PanelKeys, Running, lag_name, split_hot, with_history

KEYS = PanelKeys("entity", "date", "tie")
SCHEMA = "entity string, date date, tie int, total double"


def history(df, hot_rows, max_hot=100):
    running = [
        Running("sum_now", "sum", F.col("total")),
        Running("sum_prior", "sum", F.col("total"), prior=True),
        Running("max_now", "max", F.col("total")),
        Running("max_prior", "max", F.col("total"), prior=True),
        Running("n_big", "count", F.when(F.col("total") >= 500, 1), prior=True),
        Running("first_total", "first", F.col("total")),
    ]
    marked = split_hot(df, KEYS, max_hot=max_hot, hot_rows=hot_rows)
    return with_history(marked, KEYS, {"total": 4, "date": 2}, running, "event_no")


def by_loop(rows):
    out = {}
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    for entity in {r[0] for r in rows}:
        past = []
        for _, day, tie, total in [r for r in ordered if r[0] == entity]:
            seen, now = [p for _, p in past if p is not None], ([total] if total is not None else [])
            out[tie] = {
                "event_no": len(past) + 1,
                "sum_now": sum(seen + now) if seen + now else None,
                "sum_prior": sum(seen) if seen else None,
                "max_now": max(seen + now, default=None),
                "max_prior": max(seen, default=None),
                "n_big": sum(v >= 500 for v in seen),
                "first_total": past[0][1] if past else total,
                **{lag_name("total", k): past[-k][1] if len(past) >= k else None for k in (1, 2, 3, 4)},
                **{lag_name("date", k): past[-k][0] if len(past) >= k else None for k in (1, 2)},
            }
            past.append((day, total))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot_rows,max_hot", [(0, 100), (8, 100), (0, 2), (10**6, 100)])
def test_history_equals_a_loop(spark, seed, hot_rows, max_hot):
    rows = random_panel(seed)
    got = history(spark.createDataFrame(rows, SCHEMA), hot_rows, max_hot).collect()
    want = by_loop(rows)
    assert len(got) == len(rows)
    for r in got:
        assert {c: r[c] for c in want[r.tie]} == want[r.tie], (r.entity, r.date, r.tie)


def test_hot_entities_are_split_by_day_and_others_are_not(spark):
    rows = [("hot", *r[1:]) for r in random_panel(4, entities=1, longest=25)] + [("cold", *r[1:]) for r in random_panel(5, 1, 3)]
    n_hot = sum(r[0] == "hot" for r in rows)
    marked = split_hot(spark.createDataFrame(rows, SCHEMA), KEYS, hot_rows=n_hot - 1)
    blocks = {(r.entity, r[BLOCK]) for r in marked.collect()}
    assert {b for e, b in blocks if e == "cold"} == {None}
    assert {b for e, b in blocks if e == "hot"} == {r[1] for r in rows if r[0] == "hot"}


def test_timestamps_split_by_minute(spark):
    start = datetime(2024, 1, 1)
    rows = [("u", start + timedelta(seconds=20 * i), i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "entity string, date timestamp, tie int, total double")
    marked = split_hot(df, KEYS, hot_rows=0)
    assert marked.select(BLOCK).distinct().count() == 4
    got = with_history(marked, KEYS, {"total": 3}, (), "n").orderBy("tie").collect()
    assert [r.n for r in got] == list(range(1, 11))
    assert [r[lag_name("total", 3)] for r in got] == [None, None, None, *map(float, range(7))]


def test_main_rows_are_exchanged_once(spark):
    df = spark.createDataFrame(random_panel(1), SCHEMA)
    first = history(df, 10**6).withColumn("g", F.col("total") - F.col(lag_name("total", 1)))
    second = with_history(first, KEYS, running=[Running("best", "max", F.col("g"), prior=True)])
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # nothing is carried over without hot entities
    physical = second._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_expressions_over_lags(spark, hot_rows):
    rows = random_panel(7)
    marked = split_hot(spark.createDataFrame(rows, SCHEMA), KEYS, hot_rows=hot_rows)
    out = with_history(marked, KEYS, {"total": 4, "date": 4}).select(
        "tie",
        P.gap_days("date").alias("gap"),
        P.guarded_progress("total", "date").alias("rate"),
        P.guarded_progress("total", "date", 1).alias("prev_rate"),
        P.rolling_mean("total").alias("mean3"),
        P.rolling_mean("total", k=1).alias("prev_mean3"),
        P.rolling_std("total", k=1).alias("prev_std3"),
    )
    got = {r.tie: r for r in out.collect()}
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    for entity in {r[0] for r in rows}:
        past, rates, means = [], [], []
        for _, day, tie, total in [r for r in ordered if r[0] == entity]:
            gap = (day - past[-1][0]).days if past else None
            rate = None
            if gap is not None and gap >= 30 and total is not None and past[-1][1] is not None:
                rate = (total - past[-1][1]) / (gap / 365.25)
            last = [p for _, p in past[-2:]] + [total]
            mean = sum(last) / 3 if len(last) == 3 and None not in last else None
            r = got[tie]
            assert r.gap == gap
            assert r.rate == (None if rate is None else pytest.approx(rate))
            assert r.prev_rate == (rates[-1] if rates and rates[-1] is None else pytest.approx(rates[-1]) if rates else None)
            assert r.mean3 == (None if mean is None else pytest.approx(mean))
            assert r.prev_mean3 == (None if not means or means[-1] is None else pytest.approx(means[-1]))
            known = [p for _, p in past[-3:] if p is not None]
            if len(known) < 2:
                assert r.prev_std3 is None
            else:
                m = sum(known) / len(known)
                assert r.prev_std3 == pytest.approx((sum((v - m) ** 2 for v in known) / (len(known) - 1)) ** 0.5)
            rates.append(rate)
            means.append(mean)
            past.append((day, total))
