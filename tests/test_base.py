"""The base layer on the three-entity panel: values, leakage, order of input rows."""

from __future__ import annotations

import math
from datetime import date

import pytest
from conftest import PANEL_SCHEMA, panel_rows
from pyspark.sql import functions as F

from tracklane.operators import features as P
from tracklane.operators import history
from tracklane.operators.history import PanelKeys
from tracklane.plans import base as B
from tracklane.plans.base import KEYS, base_table, history_features
from tracklane.sources.schemas import BASE_INPUT, BASE_NAMES, LANDING_TYPES


def as_raw(spark, rows):
    """Panel rows under raw column names; the measure columns come from the panel."""
    df = spark.createDataFrame(rows, PANEL_SCHEMA).withColumnsRenamed({v: k for k, v in BASE_NAMES.items()})
    df = df.withColumns(
        {
            "event": F.lit("SBD"),
            "tested": F.lit("Yes"),
            "equipment": F.lit("Raw"),
            "meet_name": F.lit("state titles"),
            "meet_country": F.lit("AU"),
            "origin_country": F.lit("AU"),
            "place": F.lit(1).cast("bigint"),
        }
    )
    for c in BASE_INPUT:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(LANDING_TYPES[c]))
    return df.select(*BASE_INPUT, "dots")


def features(spark, rows):
    """History features with the panel's own score instead of the computed one."""
    prepared = B.row_features(as_raw(spark, rows).withColumnsRenamed(BASE_NAMES).drop("dots"))
    scores = spark.createDataFrame(rows, PANEL_SCHEMA).select("primary_key", "date", F.col("dots").alias("_score"))
    prepared = prepared.join(scores, ["primary_key", "date"]).withColumn("dots", F.col("_score")).drop("_score")
    lagged = B.with_lags(prepared.transform(history.split_hot, KEYS)).withColumns(B.history_columns())
    return B.with_career(lagged)


def events(df, key):
    return df.filter(F.col("primary_key") == key).orderBy("date").collect()


def test_career_values_of_the_panel(spark):
    out = features(spark, panel_rows()).cache()
    l1, l3 = events(out, "L1"), events(out, "L3")
    assert [r.cumulative_comps for r in l1] == [1, 2, 3, 4, 5]
    assert [r.first_comp_dots for r in l1] == [200.0] * 5
    assert [r.starting_tier for r in l1] == [1] * 5
    assert [r.prev_tier for r in l1] == [None, 1, 1, 1, 1]
    assert [r.max_dots_so_far for r in l1] == [None, 200.0, 215.0, 230.0, 245.0]
    assert [r.tiers_climbed_so_far for r in l1] == [None, 0, 0, 0, 0]
    assert [r.comps_above_elite_so_far for r in l3] == [0, 1, 2, 3, 4]
    assert [r.early_growth_rate_dots_per_year for r in l1][:3] == [None] * 3
    years = (date(2022, 6, 1) - date(2020, 6, 1)).days / 365.25
    assert l1[3].early_growth_rate_dots_per_year == pytest.approx(30 / years)
    assert l1[1].best_growth_rate_so_far is None
    assert l1[2].best_growth_rate_so_far == pytest.approx(7.5)
    assert [r.dots_growth_trend is None for r in l1] == [True, True, False, False, False]
    days = [(date(2020 + i, 6, 1) - date(2020, 6, 1)).days for i in range(5)]
    x, y = days[1:4], [200.0, 215.0, 230.0]
    mx, my = sum(x) / 3, sum(y) / 3
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    assert l1[3].dots_growth_trend == pytest.approx(slope)
    assert [r.previous_total for r in l1] == [None, 300.0, 320.0, 340.0, 360.0]
    assert l1[1].pct_change_total == pytest.approx(20 / 300 * 100)
    assert l1[0].time_gap_category == 3 and l1[1].time_gap_category == 2
    assert l1[4].log_cumulative_comps == pytest.approx(math.log(5))
    assert l1[4].tenure == days[4]


def test_early_growth_is_null_when_three_events_share_a_day(spark):
    rows = [("X", f"m{i}", date(2024, 1 + i // 3, 1), 300.0 + 10 * i, i + 1) for i in range(4)]
    df = spark.createDataFrame(rows, "primary_key string, meet_name string, date date, dots double, n int")
    df = history.split_hot(df, KEYS)
    running = [
        P.first_of("d1", "date"),
        P.first_of("v1", "dots"),
        P.value_at_event("d3", "n", 3, "date"),
        P.value_at_event("v3", "n", 3, "dots"),
    ]
    out = history.with_history(df, KEYS, running=running)
    got = out.select("n", P.early_growth("n", "d1", "v1", "d3", "v3").alias("g")).orderBy("n").collect()
    assert [r.g for r in got] == [None] * 4


PAST_ONLY = [
    *["previous_total", "previous_dots", "prev_rolling_avg_total_3", "prev_rolling_std_total_3", "prev_personal_best_total"],
    *["prev_total_progress", "prev_avg_progress_3", "prev_pct_change", "prev_pct_change_dots", "max_dots_so_far"],
    *["best_growth_rate_so_far", "dots_growth_trend", "early_growth_rate_dots_per_year", "max_tier_so_far", "prev_tier"],
    *["comps_above_elite_so_far", "prev_total_change_kg", "prev_squat_ratio", "prev_distance_from_pb_dots"],
]


@pytest.mark.parametrize("number", [2, 4, 5])
def test_features_do_not_see_their_own_event(spark, number):
    rows = panel_rows()
    changed = [
        r if r[2] != date(2019 + number, 6, 1) else (*r[:5], *[v * 1.7 for v in r[5:9]], 999.0, 999.0, r[11]) for r in rows
    ]
    before = {(r.primary_key, r.date): r for r in features(spark, rows).collect()}
    after = {(r.primary_key, r.date): r for r in features(spark, changed).collect()}
    seen = 0
    for key, r in before.items():
        if key[1] <= date(2019 + number, 6, 1):
            seen += 1
            assert {c: r[c] for c in PAST_ONLY} == {c: after[key][c] for c in PAST_ONLY}
    assert seen == 3 * number


def test_split_entities_give_the_same_base(spark, monkeypatch):
    raw = as_raw(spark, panel_rows()).drop("dots")
    plain = {(r.primary_key, r.date): r.asDict() for r in base_table(raw, "year").collect()}
    real = history.split_hot
    monkeypatch.setattr(B, "split_hot", lambda df, keys: real(df, keys, hot_rows=0))
    split = {(r.primary_key, r.date): r.asDict() for r in base_table(raw, "year").collect()}
    assert plain.keys() == split.keys() and len(plain) == 15
    for key, row in plain.items():
        for c, v in row.items():
            assert split[key][c] == (pytest.approx(v) if isinstance(v, float) else v), (key, c)


def test_input_order_does_not_matter(spark):
    rows = panel_rows()
    a = base_table(as_raw(spark, rows).drop("dots")).orderBy("primary_key", "date").collect()
    b = base_table(as_raw(spark, rows[::-1]).drop("dots").repartition(3)).orderBy("primary_key", "date").collect()
    assert a == b


def test_leakage_report_finds_a_leak(spark):
    out = features(spark, panel_rows()).cache()
    pairs = {"previous_total": "total", "prev_rolling_avg_total_3": "rolling_avg_total_3", "prev_pct_change": "pct_change_total"}
    clean = P.leakage_report(out, KEYS, "cumulative_comps", pairs)
    assert {r.feature: r.mismatches for r in clean.collect()} == dict.fromkeys(pairs, 0)
    leaky = out.withColumn("previous_total", F.col("total"))
    found = {r.feature: r.mismatches for r in P.leakage_report(leaky, KEYS, "cumulative_comps", pairs).collect()}
    assert found["previous_total"] > 0 and found["prev_pct_change"] == 0


def test_leakage_report_checks_counters_and_constants(spark):
    out = features(spark, panel_rows()).cache()
    counters = {"comps_above_advanced_so_far": ("dots", 300.0)}

    def report(df):
        found = P.leakage_report(df, KEYS, "cumulative_comps", {}, counters, ["first_comp_dots"])
        return {r.feature: r.mismatches for r in found.collect()}

    assert report(out) == {"comps_above_advanced_so_far": 0, "first_comp_dots": 0}
    now = F.col("comps_above_advanced_so_far") + (F.col("dots") >= 300).cast("int")
    leaky = out.withColumns({"comps_above_advanced_so_far": now, "first_comp_dots": F.col("dots")})
    assert all(n > 0 for n in report(leaky).values())


def test_short_gaps_blank_rates_and_what_follows(spark):
    rows = [list(r) for r in panel_rows() if r[0] == "L1"]
    rows[2][2] = date(2021, 6, 20)  # 19 days after event 2
    out = history_features(as_raw(spark, [tuple(r) for r in rows]).withColumnsRenamed(BASE_NAMES).drop("dots"))
    got = out.orderBy("date").collect()
    assert got[2].time_since_last_comp_days == 19
    assert (got[2].total_progress, got[2].pct_change_total, got[2].pct_change_dots) == (None, None, None)
    assert (got[3].prev_total_progress, got[3].prev_pct_change) == (None, None)
    assert got[3].prev_avg_progress_3 is None  # one rate of three
    assert got[4].prev_avg_progress_3 is not None


def test_every_past_only_column_is_checked_or_named(spark):
    from tracklane.queries.features import DERIVED, PAST_ONLY, leakage_rows

    out = features(spark, panel_rows()).withColumn("segment_mean_total", F.lit(500.0))
    out = out.withColumn("prev_total_vs_segment_mean", F.col("previous_total") / 500).withColumn("prev_new", F.lit(1.0)).cache()
    found = {r.feature: r.status for r in leakage_rows(out).collect()}
    assert set(found) >= {c for c in out.columns if PAST_ONLY.match(c)} >= set(DERIVED)
    assert {c for c, s in found.items() if s == "leak"} == set()
    assert {c for c, s in found.items() if s == "unchecked"} == {"prev_new", "best_growth_rate_so_far", "prev_avg_progress_3"}
    leaky = out.withColumns({c: F.col(c) + 1 for c in DERIVED})
    found = {r.feature: r.status for r in leakage_rows(leaky).collect()}
    assert all(found[c] == "leak" for c in DERIVED)


def test_truncation_finds_what_knows_the_future_or_its_own_event(spark):
    keys = PanelKeys("k", "d", "m")
    schema = "k string, d int, m string, n int, prev_fine double, prev_later double, prev_own double, prev_rank double"
    rows = lambda later, own, rank: [("a", d, "m", d, float(d), later, own, rank) for d in (1, 2)] + [("b", 1, "m", 1, 9.0, later, own, None)]
    full, cut = spark.createDataFrame(rows(1.0, 1.0, 5.0), schema), spark.createDataFrame(rows(2.0, 1.0, 5.0), schema)
    own = spark.createDataFrame(rows(1.0, 3.0, 5.0), schema).drop("prev_rank")
    columns = ["prev_fine", "prev_later", "prev_own", "prev_rank"]
    found = {r.feature: (r.from_later, r.from_own) for r in P.truncation_report(full, cut, own, keys, "n", columns).collect()}
    # b has a first event only, which may know itself
    assert found == {"prev_fine": (0, 0), "prev_later": (3, 0), "prev_own": (0, 1), "prev_rank": (0, None)}


def test_published_score_counts_and_quality_rules_drop_rows(spark):
    raw = as_raw(spark, panel_rows())
    plain = {(r.primary_key, r.date): r.dots for r in B.row_features(B.eligible_rows(raw.drop("dots"))).collect()}
    given = raw.withColumn("dots", F.when(F.col("primary_key").startswith("L1"), "123.5").otherwise("n/a"))
    scored = {(r.primary_key, r.date): r.dots for r in B.row_features(B.eligible_rows(given)).collect()}
    assert set(scored) == set(plain) and {v for (k, _), v in scored.items() if k.startswith("L1")} == {123.5}
    assert all(v == plain[k] for k, v in scored.items() if not k[0].startswith("L1"))
    bad = raw.withColumn("total_kg", F.when(F.col("primary_key").startswith("L3"), F.col("total_kg") + 50).otherwise(F.col("total_kg")))
    kept = {r.primary_key[:2] for r in B.eligible_rows(bad, quality=True).collect()}
    assert kept == {"L1", "L2"} and {r.primary_key[:2] for r in B.eligible_rows(bad).collect()} == {"L1", "L2", "L3"}


def test_lookups_by_segment_and_value_carry_few_columns(spark, monkeypatch):
    widths, lookups = [], B.segment_lookups
    monkeypatch.setattr(B, "segment_lookups", lambda rows: widths.append(len(rows.columns)) or lookups(rows))
    out = base_table(as_raw(spark, panel_rows()))
    assert widths and max(widths) <= 12 < len(out.columns)
    assert not [c for c in out.columns if c.startswith("_")]


def test_lookups_before_the_history_equal_those_after_it(spark):
    raw = as_raw(spark, panel_rows()).drop("dots")
    raw = raw.unionByName(raw)  # keys repeat; equal rows are told apart by their number
    got = base_table(raw).select("primary_key", "date", "total", "previous_total", *B.SEGMENT_COLUMNS, "total_vs_segment_mean")
    want = B.segment_features(history_features(B.eligible_rows(raw))).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_rated_layer_is_joined_and_not_written(monkeypatch):
    from types import SimpleNamespace

    from tracklane.queries import layers

    monkeypatch.setattr(layers, "store", lambda *a: pytest.fail("the wide rows were written again"))
    session, built = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="joined-test")), object()
    assert [layers._layer(session, "d", "rated", lambda: built) for _ in range(2)] == [built] * 2


def test_the_cut_guard_stores_only_what_it_reads_again(spark, monkeypatch):
    from tracklane.queries import features as Q

    names = dict.fromkeys([*(Q.BASE_NAMES.get(c, c) for c in Q.BASE_INPUT), "primary_key", "meet_name", "cumulative_comps", "prev_total"])
    base = spark.createDataFrame([], ", ".join(f"`{c}` {'date' if c == 'date' else 'string'}" for c in names if c != "date") + ", date date")
    stored, reported = {}, []
    monkeypatch.setattr(Q, "store", lambda df, label: stored.setdefault(label, df))
    wide = {c: F.lit(0.0) for c in ("prev_total", "total", "dots", "_first_dots", "never_read")}
    monkeypatch.setattr(Q, "history_features", lambda rows: rows.withColumns(wide))
    monkeypatch.setattr(Q, "segment_features", lambda rows: rows.withColumn("another", F.lit(0)))
    monkeypatch.setattr(Q.P, "truncation_report", lambda *a: reported.append(a) or a[1])
    Q.truncated(base)
    assert "never_read" not in stored["cut-history"].columns and "_first_dots" in stored["cut-history"].columns
    assert {"total", "dots", "prev_total", "date"} <= set(stored["cut-history"].columns)
    assert sorted(stored["cut-features"].columns) == sorted({"primary_key", "date", "meet_name", *reported[0][5]})
