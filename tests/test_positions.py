from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklane.operators.positions import (
    Quantile,
    add_percentile_rank,
    add_percentile_rank_asof,
    bucket_of,
    entity_median,
    group_quantiles,
    percentile_ranks_asof,
    value_positions,
)


def sample(seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for group in ("a", "b", None):
        for _ in range(draw.randint(5, 60)):
            x = draw.choice([None, 0.0, -0.001, draw.gauss(0, 1e4), draw.randint(-5, 5) * 2.5, 1e-12, draw.uniform(500, 501)])
            rows.append((group, x))
    return rows + [("all null", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_of_groups(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "g string, x double").withColumn("y", -F.col("x"))
    wanted = {
        "x": {"p1": Quantile(0.01), "p25": Quantile(0.25), "mid": Quantile(0.5), "near": Quantile(0.25, "nearest")},
        "y": {"y75": Quantile(0.75, "nearest"), "y99": Quantile(0.99)},
    }
    got = {r.g: r for r in group_quantiles(df, ["g"], wanted, {"n": "x"}).collect()}
    assert set(got) == {"a", "b", None, "all null"}
    for group, r in got.items():
        xs = sorted(x for g, x in rows if g == group and x is not None)
        assert r.n == len(xs)
        if not xs:
            assert (r.p1, r.mid, r.near, r.y75) == (None, None, None, None)
            continue
        assert [r.p1, r.p25, r.mid] == pytest.approx(list(np.quantile(xs, [0.01, 0.25, 0.5])))
        assert r.near == xs[math.floor((len(xs) - 1) * 0.25 + 0.5)]
        ys = sorted(-x for x in xs)
        assert r.y75 == ys[math.floor((len(ys) - 1) * 0.75 + 0.5)]
        assert r.y99 == pytest.approx(np.quantile(ys, 0.99))


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    row = group_quantiles(df, [], {"x": {"low": Quantile(0.01, "nearest"), "mid": Quantile(0.5)}}).first()
    assert (row.low, row.mid) == (1.0, 50.0)


def test_unknown_interpolation(spark):
    with pytest.raises(ValueError, match="unknown interpolation"):
        group_quantiles(spark.createDataFrame([(1.0,)], "x double"), [], {"x": {"m": Quantile(0.5, "upper")}})


@pytest.mark.parametrize("seed", [1, 2])
def test_percentile_rank_is_the_average_rank(spark, seed):
    rows = [(i, g, x) for i, (g, x) in enumerate(sample(seed))]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    got = {r.i: r.p for r in add_percentile_rank(df, ["g"], "x", "p").collect()}
    frame = pd.DataFrame(rows, columns=["i", "g", "x"])
    ranked = frame.groupby("g", dropna=False)["x"]
    frame["p"] = ranked.rank(method="average") / ranked.transform("count") * 100
    assert len(got) == len(rows)
    for i, p in zip(frame["i"], frame["p"]):
        assert got[i] == (None if pd.isna(p) else pytest.approx(p))


@pytest.mark.parametrize("days", [1, 2, 37])
def test_percentile_rank_asof_knows_no_later_row(spark, days):
    draw = random.Random(days)
    day = lambda: draw.choice([None, *range(days)]) if days > 2 else draw.randrange(days)
    rows = [(i, g, day(), x) for i, (g, x) in enumerate(sample(days))]
    df = spark.createDataFrame(rows, "i int, g string, day int, x double").withColumn("day", F.date_add(F.lit("2020-02-20"), F.col("day")))
    got = {r.i: r.p for r in add_percentile_rank_asof(df, ["g"], "day", "x", "p").collect()}
    assert set(got) == set(range(len(rows)))
    for i, g, d, x in rows:
        if x is None or d is None:
            assert got[i] is None
            continue
        known = [y for _, h, e, y in rows if h == g and e is not None and e <= d and y is not None]
        want = (sum(y < x for y in known) + (sum(y == x for y in known) + 1) / 2) / len(known) * 100
        assert got[i] == pytest.approx(want)


def test_percentile_rank_asof_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, day date, x double")
    assert add_percentile_rank_asof(df, ["g"], "day", "x", "p").collect() == []


def test_ranks_as_of_a_date_are_not_broadcast(spark):
    df = spark.createDataFrame([("a", "2020-02-20", 1.0), ("a", "2020-02-21", 2.0)], "g string, day string, x double")
    df = df.withColumn("day", F.col("day").cast("date"))
    for ranked in (
        percentile_ranks_asof(df, ["g"], "day", {"x": F.col("x")}),
        add_percentile_rank_asof(df, ["g"], "day", "x", "p"),
    ):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_value_may_fill_a_group(spark):
    df = spark.range(10_000).selectExpr("'hot' AS g", "IF(id < 9990, 7.0D, CAST(id AS DOUBLE)) AS x")
    placed = value_positions(df, ["g"], "x")
    hot = placed.filter("x = 7.0").first()
    assert (placed.count(), hot.copies, hot.before, hot["size"]) == (11, 9990, 0, 10_000)


def test_special_values_have_buckets(spark):
    df = spark.createDataFrame([(float("-inf"),), (-1.0,), (-0.0,), (1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = [r.b for r in df.select(bucket_of(F.col("x")).alias("b")).collect()]
    assert got[-1] is None
    assert got[:-1] == sorted(got[:-1]) and got[2] == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=40))
def test_buckets_keep_the_order(spark, values):
    df = spark.createDataFrame([(v,) for v in sorted(values)], "x double")
    buckets = [(r.x, r.b) for r in df.select("x", bucket_of(F.col("x")).alias("b")).collect()]
    buckets.sort()
    assert all(a[1] <= b[1] for a, b in zip(buckets, buckets[1:]))


@pytest.mark.parametrize("hot_rows", [0, 10, 10**6])
def test_entity_median(spark, hot_rows):
    draw = random.Random(5)
    rows = [(f"e{e}", draw.choice([None, draw.uniform(-9, 9)])) for e in range(4) for _ in range(draw.randint(1, 30))]
    df = spark.createDataFrame(rows, "e string, x double")
    got = {r.e: r.m for r in entity_median(df, "e", "x", "m", hot_rows=hot_rows).collect()}
    want = pd.DataFrame(rows, columns=["e", "x"]).groupby("e")["x"].median()
    assert set(got) == set(want.index)
    for e, m in want.items():
        assert got[e] == (None if pd.isna(m) else pytest.approx(m))
