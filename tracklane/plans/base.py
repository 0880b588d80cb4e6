"""Raw to base: eligible results with all per-entity, segment and rating features.

Written in levels, one ``select`` each, so that windows over the same keys share
one exchange. Between levels whose input is read several times the rows are
stored once in the shared folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.functions import columns as C
from tracklane.operators import features as P
from tracklane.operators.clean import apply_rules, fill_defaults, keep_event, quality_rules
from tracklane.operators.history import BLOCK, PanelKeys, split_hot, with_history
from tracklane.operators.identity import resolve_entities
from tracklane.operators.positions import lookup_percentile, percentile_ranks, percentile_ranks_asof
from tracklane.operators.rating import field_rating, meet_rating
from tracklane.operators.segments import add_segment_mean
from tracklane.runtime import store
from tracklane.sources.schemas import BASE_INPUT, BASE_NAMES

KEYS = PanelKeys("primary_key", "date", "meet_name")
SEGMENT = ["sex", "ipf_weight_class"]
PARTS = ["squat", "bench", "deadlift"]
MEASURES = ["total", *PARTS]
SOURCE_SCORE = "source_dots"
ABOVE_TIER = ("intermediate", "advanced", "elite", "world_class")


def base_events(raw: DataFrame) -> DataFrame:
    """Base columns under base names, defaults filled, of eligible events; a published score goes along as ``source_dots``."""
    published = [F.col("dots").try_cast("double").alias(SOURCE_SCORE)] if "dots" in raw.columns else []
    return (
        raw.select(*BASE_INPUT, *published)
        .withColumnsRenamed(BASE_NAMES)
        .transform(fill_defaults, {"parent_federation": "Independent", "meet_name": "local"})
        .transform(keep_event)
    )


def eligible_rows(raw: DataFrame, settings: Settings = SETTINGS, quality: bool = False) -> DataFrame:
    """``base_events`` of active entities; with ``quality`` only those that meet every quality rule."""
    events = base_events(raw)
    if quality:
        events = apply_rules(events, quality_rules(settings))
    return resolve_entities(events, settings=settings)


def row_features(rows: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Level 0: what a row alone determines."""
    age = F.year("date") - F.col("birth_year")
    score = C.dots("sex", "bodyweight", "total", settings)
    if SOURCE_SCORE in rows.columns:  # the published score counts, the formula fills its gaps
        score = F.coalesce(SOURCE_SCORE, score)
    return rows.withColumns(
        {
            "ipf_weight_class": C.weight_class("sex", "bodyweight", settings),
            "meet_type": C.meet_type("meet_name"),
            "is_origin_country": F.col("meet_country") == F.col("origin_country"),
            "approx_age": age,
            "years_from_peak_age": age - settings.peak_age,
            "abs_years_from_peak_age": F.abs(age - settings.peak_age),
            "total_per_bw": C.ratio("total", "bodyweight"),
            "dots": score,
            **{f"{p}_ratio": C.ratio(p, "total") for p in PARTS},
        }
    )


def with_lags(rows: DataFrame, keys: PanelKeys = KEYS, settings: Settings = SETTINGS) -> DataFrame:
    """Level 1: one pass over each entity's ordered events."""
    lags = {"date": 4, "total": 4, "dots": 3, "wilks": 1, "bodyweight": 1, **{p: 3 for p in PARTS}}
    firsts = ["date", "total", "bodyweight", "dots", "approx_age", *SEGMENT]
    running = [
        P.running_max_prior("_best_total", "total"),
        P.running_max_prior("_best_dots", "dots"),
        *[P.first_of(f"_first_{c}", c) for c in firsts],
        *[
            P.count_prior_at_least(f"comps_above_{name}_so_far", "dots", bound)
            for name, bound in zip(ABOVE_TIER, settings.tier_bounds)
        ],
    ]
    return with_history(rows, keys, lags, running, event_no="cumulative_comps")


def history_columns(date: str = "date", settings: Settings = SETTINGS) -> dict[str, Column]:
    """Level 2: every feature that is an expression over lags and running values."""
    lag = {m: P.at(m, 1) for m in [*MEASURES, "wilks", "dots", "bodyweight"]}
    tenure = P.tenure_days(date, "_first_date", "cumulative_comps")
    days, years = P.gap_days(date), P.gap_years(date, settings=settings)
    best_total, best_dots = P.masked("_best_total", lag["total"]), P.masked("_best_dots", lag["dots"])
    out = {
        "time_since_last_comp_days": days,
        "time_since_last_comp_years": years,
        "time_gap_category": C.gap_category(days, settings),
        "tenure": tenure,
        "years_competing": tenure / settings.days_in_year,
        "log_cumulative_comps": F.log(F.col("cumulative_comps").cast("double")),
        "comps_per_year": F.when(tenure > 0, C.ratio("cumulative_comps", tenure / settings.days_in_year)),
        **{f"previous_{m}": lag[m] for m in [*MEASURES, "wilks", "dots"]},
        "bodyweight_change": P.change("bodyweight"),
        **{f"prev_{p}_ratio": C.ratio(lag[p], lag["total"]) for p in PARTS},
        "prev_total_per_bw": C.ratio(lag["total"], "bodyweight"),
        "prev_total_change_kg": P.change("total", 1),
        **{f"rolling_avg_{m}_3": P.rolling_mean(m) for m in [*MEASURES]},
        **{f"prev_rolling_avg_{m}_3": P.rolling_mean(m, k=1) for m in [*MEASURES]},
        "prev_rolling_std_total_3": P.rolling_std("total", k=1),
        "prev_personal_best_total": best_total,
        "prev_total_vs_pb": C.ratio(lag["total"], best_total),
        "prev_distance_from_pb": best_total - lag["total"],
        **{f"{m}_progress": P.guarded_progress(m, date, settings=settings) for m in [*PARTS, "total", "wilks"]},
        "pct_change_total": P.guarded_pct_change("total", date, settings=settings),
        "prev_total_progress": P.guarded_progress("total", date, 1, settings),
        "prev_avg_progress_3": C.mean_of([P.guarded_progress("total", date, k, settings) for k in (3, 2, 1)], 2),
        "prev_pct_change": P.guarded_pct_change("total", date, 1, settings),
        "prev_total_x_time_gap": lag["total"] * years,
        "prev_total_per_comp": C.ratio(lag["total"], "cumulative_comps"),
        # the same features of the bodyweight-adjusted score
        "dots_progress": P.guarded_progress("dots", date, settings=settings),
        "pct_change_dots": P.guarded_pct_change("dots", date, settings=settings),
        "prev_pct_change_dots": P.guarded_pct_change("dots", date, 1, settings),
        "rolling_avg_dots_3": P.rolling_mean("dots"),
        "prev_rolling_avg_dots_3": P.rolling_mean("dots", k=1),
        "prev_dots_personal_best": best_dots,
        "prev_dots_vs_pb": C.ratio(lag["dots"], best_dots),
        "prev_distance_from_pb_dots": best_dots - lag["dots"],
        # first event and career so far
        "first_comp_dots": F.col("_first_dots"),
        "first_comp_total_per_bw": C.ratio("_first_total", "_first_bodyweight"),
        "first_comp_age": F.col("_first_approx_age"),
        "max_dots_so_far": best_dots,
        "starting_tier": C.tier("_first_dots", settings),
        "prev_tier": C.tier(lag["dots"], settings),
        "max_tier_so_far": C.tier(best_dots, settings),
        "tiers_climbed_so_far": C.tier(best_dots, settings) - C.tier("_first_dots", settings),
        "starting_tier_x_years_competing": C.tier("_first_dots", settings) * (tenure / settings.days_in_year),
        "max_tier_x_time_gap": C.tier(best_dots, settings) * years,
    }
    return out


def with_career(rows: DataFrame, keys: PanelKeys = KEYS, settings: Settings = SETTINGS) -> DataFrame:
    """Level 3: running values of columns that are themselves features; same partitioning."""
    since_first = F.datediff("date", "_first_date")
    running = [
        P.running_max_prior("_best_growth", "pct_change_dots"),
        P.value_at_event("_third_dots", "cumulative_comps", 3, "dots"),
        P.value_at_event("_third_date", "cumulative_comps", 3, "date"),
        *P.trend_running("_trend", since_first, F.col("previous_dots")),
    ]
    growth = P.early_growth("cumulative_comps", "_first_date", "_first_dots", "_third_date", "_third_dots", settings)
    return with_history(rows, keys, running=running).withColumns(
        {
            "best_growth_rate_so_far": P.masked("_best_growth", F.col("prev_pct_change_dots")),
            "early_growth_rate_dots_per_year": growth,
            "dots_growth_trend": F.when(F.col("previous_dots").isNotNull(), P.trend_slope("_trend")),
        }
    )


def history_features(rows: DataFrame, keys: PanelKeys = KEYS, settings: Settings = SETTINGS) -> DataFrame:
    """Levels 0 to 3."""
    return with_features(row_features(rows, settings).transform(split_hot, keys), keys, settings)


def with_features(prepared: DataFrame, keys: PanelKeys = KEYS, settings: Settings = SETTINGS) -> DataFrame:
    """Levels 1 to 3 on rows with row features and the block column."""
    lagged = with_lags(prepared, keys, settings).withColumns(history_columns(settings=settings))
    lag_columns = [c for c in lagged.columns if c.startswith("_lag")]
    return with_career(lagged.drop(*lag_columns), keys, settings)


ROW = "_row"
NUMBERED = replace(KEYS, last=ROW)  # two passes over a history see rows of one key in the same order


def segment_inputs(rows: DataFrame, keys: PanelKeys = NUMBERED) -> DataFrame:
    """What ``segment_lookups`` reads of rows with a number and the block column, and no more."""
    narrow = rows.select(keys.entity, *keys.order(), BLOCK, *SEGMENT, "total", "dots")
    firsts = [P.first_of(f"_first_{c}", c) for c in ("dots", *SEGMENT)]
    narrow = with_history(narrow, keys, {"total": 1}, firsts, event_no="cumulative_comps")
    narrow = narrow.withColumn("previous_total", P.at("total", 1))
    return narrow.select(
        *[ROW, keys.date, *SEGMENT, "total", "dots", "previous_total", "cumulative_comps"], *[r.name for r in firsts]
    )


def segment_lookups(rows: DataFrame) -> DataFrame:
    """Running means and ranks of the segment, each looked up by value.

    First scores are ranked among first events only. Every row carries its
    entity's first segment and score, so that rank needs no join on the entity.
    """
    first_score = F.when(F.col("cumulative_comps") == 1, F.col("dots"))
    measures = {"total": F.col("total"), "previous": F.col("previous_total"), "first": first_score}
    ranks = store(percentile_ranks(rows, SEGMENT, measures), "percentile-ranks")
    first_segment = [f"_first_{c}" for c in SEGMENT]
    return (
        rows.transform(add_segment_mean, SEGMENT, "date", "total", "segment_mean_total")
        .transform(lookup_percentile, ranks, "total", SEGMENT, "total", "total_percentile_rank")
        .transform(lookup_percentile, ranks, "previous", SEGMENT, "previous_total", "prev_total_percentile_rank")
        .transform(lookup_percentile, ranks, "first", first_segment, "_first_dots", "first_comp_percentile_vs_sex_wc")
    )


SEGMENT_COLUMNS = ["segment_mean_total", "total_percentile_rank", "prev_total_percentile_rank", "first_comp_percentile_vs_sex_wc"]


def segment_ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "total_vs_segment_mean": C.ratio("total", "segment_mean_total"),
            "prev_total_vs_segment_mean": C.ratio("previous_total", "segment_mean_total"),
        }
    )


def segment_features(rows: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Means and ranks of the segment, looked up for rows with history features."""
    return segment_ratios(segment_lookups(rows))


def past_rank_features(featured: DataFrame) -> DataFrame:
    """Ranks that know no later row: of the previous total up to the event, of the first score up to the first event.

    ``featured`` are rows with history features. The ranks of ``segment_features`` go over the whole history.
    """
    first_score = F.when(F.col("cumulative_comps") == 1, F.col("dots"))
    measures = {"previous": F.col("previous_total"), "first": first_score}
    ranks = store(percentile_ranks_asof(featured, SEGMENT, KEYS.date, measures), "percentile-ranks").hint("merge")
    now = [*SEGMENT, KEYS.date]
    first = [f"_first_{c}" for c in now]
    return featured.transform(
        lookup_percentile, ranks, "previous", now, "previous_total", "prev_total_percentile_rank_asof"
    ).transform(lookup_percentile, ranks, "first", first, "_first_dots", "first_comp_percentile_asof")


MEET = "meet"  # rate meet by meet
RATING_COLUMNS = ["elo_rating", "elo_change", "meet_field_elo", "prev_elo_change"]


def rating_features(rows: DataFrame, period: str = MEET, settings: Settings = SETTINGS) -> DataFrame:
    """Rating before the event, its change, the field's mean, and the change of the event before.

    By default meet by meet; a ``period`` rates all meets of that length from one start.
    """
    key = [KEYS.entity, *KEYS.order()]
    contest = {
        "entity": KEYS.entity,
        "date": KEYS.date,
        "field": ["meet_name", *SEGMENT],
        "measure": "total",
        "tie": KEYS.tie,
        "meet_type": "meet_type",
        "settings": settings,
    }
    if period == MEET:
        rated = meet_rating(rows, **contest)
    else:
        contest["field"] = ["meet_name", *([] if period != "day" else ["date"]), *SEGMENT]
        rated = field_rating(rows, period=period, **contest)
    # A change is known only after its event: models get the one before.
    rated = with_history(split_hot(rated, KEYS), KEYS, {"elo_change": 1})
    rated = rated.withColumn("prev_elo_change", P.at("elo_change", 1)).select(*key, *RATING_COLUMNS)
    rated = store(rated, "ratings")  # narrow: a reader joins only the columns it wants
    return rows.join(rated, key, "left").withColumn("elo_gap_vs_field", F.col("elo_rating") - F.col("meet_field_elo"))


def base_table(raw: DataFrame, period: str | None = None, settings: Settings = SETTINGS, quality: bool = False) -> DataFrame:
    """The base layer; ``period`` adds the rating in rounds of that length, ``quality`` drops implausible rows first."""
    # A row has some 25 columns before its history and over 100 after it. What is looked up by segment and value goes
    # along as a few columns and meets the rows by their number before the history is made, so that wide rows are never
    # exchanged for a lookup.
    numbered = eligible_rows(raw, settings, quality).withColumn(ROW, F.monotonically_increasing_id())
    rows = store(numbered, "eligible")
    inputs = segment_inputs(row_features(rows, settings).transform(split_hot, NUMBERED))
    looked = segment_lookups(store(inputs, "segment-inputs")).select(ROW, *SEGMENT_COLUMNS)
    rows = store(rows.join(looked, ROW), "looked-up")
    rows = row_features(rows, settings).transform(split_hot, NUMBERED)
    full = segment_ratios(with_features(rows, NUMBERED, settings))
    if period:
        full = rating_features(full, period, settings)
    return full.drop(*[c for c in full.columns if c.startswith("_")])
