from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tracklane.operators.segments import add_segment_mean


def rows_of(seed):
    draw = random.Random(seed)
    return [
        (i, draw.choice(["M", "F", None]), date(2020, 1, 1) + timedelta(days=draw.randint(0, 9)), draw.choice([None, float(draw.randint(1, 99))]))
        for i in range(80)
    ]


@pytest.mark.parametrize("mode", ["date", "row"])
def test_segment_mean_leaves_the_row_out(spark, mode):
    rows = rows_of(11)
    df = spark.createDataFrame(rows, "tie int, sex string, date date, total double")
    got = {r.tie: r.m for r in add_segment_mean(df, ["sex"], "date", "total", "m", mode, "tie").collect()}
    assert len(got) == len(rows)
    for tie, sex, day, _ in rows:
        earlier = [t for i, s, d, t in rows if s == sex and t is not None and (d < day or (mode == "row" and d == day and i < tie))]
        assert got[tie] == (pytest.approx(sum(earlier) / len(earlier)) if earlier else None)


def test_unknown_mode(spark):
    df = spark.createDataFrame(rows_of(1), "tie int, sex string, date date, total double")
    with pytest.raises(ValueError, match="unknown mode"):
        add_segment_mean(df, ["sex"], "date", "total", "m", "week")
