from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tracklane.operators import analyses as A
from tracklane.operators import describe as D
from tracklane.operators import metrics as M

SCHEMA = (
    "primary_key string, date date, meet_name string, sex string, ipf_weight_class string, cumulative_comps bigint, "
    "total double, wilks double, tenure int, total_progress double"
)


def rows_of():
    totals = {
        "a": ("M", "83", [310, 420, 390]),
        "b": ("M", "83", [None, 450, 500]),
        "c": ("M", "93", [290, 300]),
        "d": ("F", "63", [160, 210, 255]),
        "u": ("F", "unknown", [160, 210, 255]),
        "x": ("Mx", "83", [700]),
    }
    for key, (sex, wc, values) in totals.items():
        for i, t in enumerate(values):
            t = None if t is None else float(t)
            rate = None if i == 0 else 10.0 * i
            yield key, date(2020 + i, 1, 1), "m", sex, wc, i + 1, t, 200.0 + i, None if i == 0 else 365 * i, rate


@pytest.fixture
def base(spark):
    return spark.createDataFrame(list(rows_of()), SCHEMA)


def attainment(df):
    return {(r.sex, r.ipf_weight_class, r.milestone_kg, r.cumulative_comps): r.fraction_reached for r in df.collect()}


def test_milestones_running_max(base):
    got = attainment(A.milestone_attainment(base))
    assert got["M", "83", 300, 1] == 0.5  # only a
    assert got["M", "83", 300, 2] == 1.0
    assert got["M", "83", 400, 2] == 1.0
    assert got["M", "83", 500, 3] == 0.5
    assert got["F", "63", 250, 3] == 1.0
    assert ("M", "83", 600, 3) not in got
    assert not any(wc == "unknown" or sex == "Mx" for sex, wc, _, _ in got)


def test_milestones_cumulative_counts_first_attainment(spark, base):
    # c reaches 300 at event 2 and stops; a later event of another entity must not lose it
    extra = [("e", date(2020 + i, 1, 1), "m", "M", "93", i + 1, 310.0, 1.0, None, None) for i in range(3)]
    df = base.unionByName(spark.createDataFrame(extra, SCHEMA))
    cumulative = attainment(A.milestone_attainment(df, mode="cumulative"))
    assert cumulative["M", "93", 300, 1] == 0.5
    assert cumulative["M", "93", 300, 2] == 1.0
    assert ("M", "93", 300, 3) not in cumulative  # nobody new at event 3


def test_career_summary_drops_incomplete_careers(base):
    got = {r.primary_key: r for r in A.career_summary(base).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"].total_comps, got["a"].max_total, got["a"].median_progress, got["a"].career_tenure) == (3, 420.0, 15.0, 730)


def test_archetypes_cover_every_career(spark):
    rows = []
    for e in range(40):
        for i in range(3):
            group = e % 5
            rows.append((f"e{e}", date(2020 + i, 1, 1), "m", "M", "83", i + 1, 100.0 * group + i, 50.0 * group + e % 3, 90 * i + 1, group * 10.0 + i))
    assigned, centroids = A.archetypes(spark.createDataFrame(rows, SCHEMA))
    assert assigned.count() == 40
    found = centroids.orderBy("max_total").collect()
    assert len(found) == 5
    assert [r.max_total for r in found] == pytest.approx([2.0, 102.0, 202.0, 302.0, 402.0])
    clusters = {(int(r.primary_key[1:]) % 5, r.cluster) for r in assigned.collect()}
    assert len(clusters) == 5  # one cluster per group


def test_restarts_share_a_pass_and_find_the_best(spark):
    from dataclasses import replace

    import numpy as np

    draw = np.random.default_rng(3)
    spots = draw.normal(size=(60, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 20, axis=0)
    points = spark.createDataFrame([(f"p{i:02d}", [float(v) for v in z]) for i, z in enumerate(spots)], "k string, z array<double>")
    settings = replace(A.SETTINGS, clusters=3, cluster_restarts=4)
    assigned, centres = A.k_means(points, "k", settings)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.cluster, set()).add(int(r.k[1:]) // 20)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
    for cluster, (group,) in groups.items():
        assert np.allclose(centres[cluster], spots[group * 20 : group * 20 + 20].mean(axis=0))
    same = spark.createDataFrame([(f"p{i}", [1.0, 2.0]) for i in range(4)], "k string, z array<double>")  # fewer points than clusters
    alike, _ = A.k_means(same, "k", settings)
    assert {r.cluster for r in alike.collect()} == {0}
    none = A.archetypes(spark.createDataFrame([], SCHEMA))
    assert [t.count() for t in none] == [0, 0]


def test_quality_report(base):
    got = {r.metric: r.value for r in D.quality_report(base).collect()}
    assert got["total_records"] == "15" and got["unique_lifters"] == "6"
    assert (got["date_range_start"], got["date_range_end"]) == ("2020-01-01", "2022-01-01")
    assert got["mean_comps_per_lifter"] == "2.5"
    assert got["columns_with_gt_1pct_nulls"] == '{"tenure":0.4,"total":0.0667,"total_progress":0.4}'


def test_tier_transitions(spark):
    rows = [("a", 1, 250.0), ("a", 1, 350.0), ("b", 1, 210.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "primary_key string, starting_tier int, dots double")
    (row,) = D.tier_transitions(df).collect()
    assert (row.starting_tier, row.tier, row.entities, row.to_1, row.to_2, row.too_few) == (1, "Intermediate", 2, 1, 1, True)


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (30.0, 32.0), (40.0, 38.0), (50.0, 50.0)], "y double, pred double")
    m = M.regression_metrics(df, "y", "pred").first()
    assert (m.n, m.mse, m.mae, m.median_ae) == (5, pytest.approx(3.2), pytest.approx(1.6), 2.0)
    assert m.r2 == pytest.approx(1 - 16 / 1000)
    s = M.scale_free_metrics(df, "y", "pred").first()
    assert s.rmse_normalised == pytest.approx(3.2**0.5 / 200**0.5)
    monotone = df.withColumn("pred", 2 * F.col("y") + 10)
    assert M.scale_free_metrics(monotone, "y", "pred").first().spearman_rho == pytest.approx(1.0)


def test_prediction_table_keeps_shared_columns_of_either_side(spark):
    a = spark.createDataFrame([("x", 1, 0.1, 2), ("y", 1, 0.2, 3)], "k string, d int, pa double, tier int")
    b = spark.createDataFrame([("y", 1, 0.5, 3), ("z", 1, 0.6, 4)], "k string, d int, pb double, tier int")
    table = M.prediction_table(a, b, ["k", "d"], ["tier"])
    assert sorted(map(tuple, table.select("k", "pa", "pb", "tier").collect())) == [
        ("x", 0.1, None, 2),
        ("y", 0.2, 0.5, 3),
        ("z", None, 0.6, 4),
    ]
    assert tuple(M.prediction_overlap(table, "pa", "pb").first()) == (1, 1, 1)


def test_importance_delta(spark):
    rows = [(v, f, w) for v, fs in (("v1", "abc"), ("v2", "abd")) for f, w in zip(fs, (3.0, 2.0, 1.0))]
    ranks = M.importance_ranks(spark.createDataFrame(rows, "version string, feature string, importance double"), top=3)
    assert {tuple(r) for r in M.importance_delta(ranks, "v1", "v2").collect()} == {("c", 3, "dropped out"), ("d", 3, "entered")}


def test_regression_guard(spark):
    scores = spark.createDataFrame([("kg", 0.34), ("dots", 0.10)], "target string, r2 double")
    M.regression_guard(scores, {"kg": 0.351, "dots": 0.0})
    with pytest.raises(M.RegressionGuardError, match="kg"):
        M.regression_guard(scores, {"kg": 0.361, "dots": 0.0})


def test_seeds_are_drawn_without_sorting_points_by_restart(spark, monkeypatch):
    import hashlib
    import math

    from tracklane.config import Settings
    from tracklane.operators import analyses

    settings = Settings(clusters=2, cluster_restarts=2)
    rows = [(f"k{i}", [float(i % 4), float(i)]) for i in range(12)]
    points = spark.createDataFrame(rows, "k string, z array<double>")
    grouped = type(points).groupBy
    monkeypatch.setattr(type(points), "groupBy", lambda df, *by: pytest.fail(f"grouped by {by}") if by else grouped(df))
    got = analyses._seeds(points, "k", settings)

    def drawn(k, restart, seed):
        text = f"{k}:{restart}:{seed}:{settings.cluster_seed}"
        return math.log((int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    for restart, (first, second) in enumerate(got):
        assert first == min(rows, key=lambda r: 1 / drawn(r[0], restart, 0))[1]
        apart = lambda z: sum((a - b) ** 2 for a, b in zip(z, first))
        assert second == min(rows, key=lambda r: apart(r[1]) / drawn(r[0], restart, 1))[1]
