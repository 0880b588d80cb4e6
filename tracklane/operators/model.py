"""Model rows, temporal split, boosted-tree regression and its search."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.functions import columns as C
from tracklane.operators import metrics as M
from tracklane.operators.boosting import Boosted, Trial, binned, boost, fit_bins, training_mean
from tracklane.operators.positions import Quantile, group_quantiles
from tracklane.runtime import store

KEYS = ["primary_key", "date", "meet_name"]
CATEGORICAL = ["parent_federation"]

# The search. Rounds from, to, in steps of; rounds without a better validation error; rounds before pruning.
SEARCH_TRIALS = 500
SEARCH_DEPTHS = (3, 12)
SEARCH_STEPS = (1e-8, 1.0)  # of step size, l1, l2 and gamma, drawn by their logarithm
SEARCH_ROUNDS = (200, 2000, 100)
SEARCH_SUBSAMPLE = (0.5, 1.0)
SEARCH_FEATURE_SHARE = (0.3, 1.0)
SEARCH_CHILD_WEIGHT = (1, 30)
PATIENCE = 50
WARMUP = 50

JOB_TRIALS = 60  # of the job and its queries; a parameter

# The feature set, in the order of the model frame.
FEATURES = [
    "bodyweight",
    "age_class_encoded",
    "sex_encoded",
    "ipf_wc_numeric",
    "parent_federation",
    "time_since_last_comp_years",
    "bodyweight_change",
    "cumulative_comps",
    "tenure",
    "is_origin_country_int",
    "prev_total_percentile_rank",
    "prev_total_per_bw",
    "segment_mean_total",
    "previous_squat",
    "previous_bench",
    "previous_deadlift",
    "previous_total",
    "previous_wilks",
    "elo_rating",
    "elo_change",
    "prev_distance_from_pb",
    "prev_total_progress",
    "prev_avg_progress_3",
    "comps_per_year",
    "prev_rolling_std_total_3",
    "approx_age",
    "abs_years_from_peak_age",
    "prev_total_change_kg",
    "prev_total_x_time_gap",
    "prev_total_per_comp",
    "log_cumulative_comps",
    "years_competing",
    "prev_pct_change",
    "time_gap_category",
]
# What versions 9 and 10 add.
SCORE_FEATURES = [
    "previous_dots",
    "prev_pct_change_dots",
    "prev_dots_vs_pb",
    "prev_distance_from_pb_dots",
    "prev_rolling_avg_dots_3",
]
POTENTIAL_FEATURES = [
    "first_comp_dots",
    "first_comp_total_per_bw",
    "first_comp_age",
    "first_comp_percentile_vs_sex_wc",
    "max_dots_so_far",
    "best_growth_rate_so_far",
    "dots_growth_trend",
    "early_growth_rate_dots_per_year",
    "comps_above_intermediate_so_far",
    "comps_above_advanced_so_far",
    "comps_above_elite_so_far",
    "comps_above_world_class_so_far",
    "starting_tier",
    "prev_tier",
    "max_tier_so_far",
    "tiers_climbed_so_far",
    "starting_tier_x_years_competing",
    "max_tier_x_time_gap",
]


def feature_set(version: int, post_event: bool = False) -> list[str]:
    """Features of version 8, 9 (adds the score) or 10 and later (adds potential).

    ``elo_change`` is known only after the event, so the change of the event
    before takes its place unless ``post_event`` asks for it.
    """
    base = FEATURES if post_event else ["prev_elo_change" if f == "elo_change" else f for f in FEATURES]
    return base + (SCORE_FEATURES if version >= 9 else []) + (POTENTIAL_FEATURES if version >= 10 else [])


# --- rows -----------------------------------------------------------------------


def winsorize(df: DataFrame, col: str, interpolation: str = "nearest", settings: Settings = SETTINGS) -> DataFrame:
    """Clip a column to its own low and high quantile; null stays null."""
    low, high = (Quantile(q, interpolation) for q in settings.winsor_bounds)
    bounds = store(group_quantiles(df, [], {col: {"low": low, "high": high}}), "winsor-bounds")
    clipped = F.greatest(F.least(F.col(col), bounds.select("high").scalar()), bounds.select("low").scalar())
    return df.withColumn(col, F.when(F.col(col).isNotNull(), clipped))


def encode_categories(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return df.withColumns(
        {
            "sex_encoded": C.strict_lookup("sex", settings.sex_code, "sex"),
            "age_class_encoded": C.strict_lookup("age_class", settings.age_class_midpoint, "age class"),
            "ipf_wc_numeric": C.weight_class_number("ipf_weight_class"),
            "is_origin_country_int": F.col("is_origin_country").cast("int"),
        }
    )


def eligible_for_model(df: DataFrame, target: str, settings: Settings = SETTINGS) -> DataFrame:
    """Rows with a target and a gap long enough for a rate to mean something."""
    return df.filter(
        F.col(target).isNotNull() & (F.col("time_since_last_comp_years") >= settings.model_min_gap_years)
    )


def model_frame(
    base: DataFrame,
    target: str = "pct_change_total",
    features: Sequence[str] | None = None,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Name, date, features and the winsorised target, plus the entity columns for joining back."""
    features = list(features or feature_set(8))
    rows = eligible_for_model(base, target, settings).transform(winsorize, target, settings=settings)
    rows = rows.transform(encode_categories, settings)
    extra = [c for c in ("starting_tier",) if c in rows.columns and c not in features]
    return rows.select("primary_key", "meet_name", "name", "date", *features, *extra, target)


# --- split ----------------------------------------------------------------------


def split_dates(df: DataFrame, date: str = "date", settings: Settings = SETTINGS) -> DataFrame:
    """One row: the dates at sorted row ``int(n q)`` for both cut-offs, from counts per date."""
    daily = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    # One row per date, so the unpartitioned window is as long as the calendar.
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    daily = daily.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(whole)})

    def cut(q: float) -> Column:
        return F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * F.lit(q)), F.col(date)))

    return daily.agg(cut(settings.train_cutoff).alias("train_end"), cut(settings.val_cutoff).alias("val_end"))


def temporal_split(
    df: DataFrame, date: str = "date", cuts: DataFrame | None = None, settings: Settings = SETTINGS
) -> DataFrame:
    """Label rows train, val or test by date."""
    cuts = cuts if cuts is not None else split_dates(df, date, settings)
    train_end, val_end = cuts.select("train_end").scalar(), cuts.select("val_end").scalar()
    label = F.when(F.col(date) <= train_end, "train").when(F.col(date) <= val_end, "val").otherwise("test")
    return df.withColumn("split", label)


# --- fit ------------------------------------------------------------------------


def random_trials(
    n: int = SEARCH_TRIALS,
    max_iter: int | None = None,
    seed: int = 7,
    depths: tuple[int, int] = SEARCH_DEPTHS,
    steps: tuple[float, float] = SEARCH_STEPS,
    rounds: tuple[int, int, int] = SEARCH_ROUNDS,
) -> list[Trial]:
    """``n`` draws from the search space; the same seed gives the same list. ``max_iter`` fixes the rounds."""
    draw = random.Random(seed)
    low, high = (math.log10(s) for s in steps)

    def small() -> float:
        return 10 ** draw.uniform(low, high)

    return [
        Trial(
            max_depth=draw.randint(*depths),
            step_size=small(),
            max_iter=max_iter or draw.randrange(rounds[0], rounds[1] + 1, rounds[2]),
            subsample=draw.uniform(*SEARCH_SUBSAMPLE),
            feature_share=draw.uniform(*SEARCH_FEATURE_SHARE),
            min_child_weight=draw.randint(*SEARCH_CHILD_WEIGHT),
            l2=small(),
            l1=small(),
            gamma=small(),
            seed=seed,
        )
        for _ in range(n)
    ]


@dataclass
class Fitted:
    predictions: DataFrame
    model: Boosted
    rounds: int


def _categorical(features: Sequence[str]) -> list[str]:
    return [f for f in features if f in CATEGORICAL]


def _identity(df: DataFrame) -> list[str]:
    """What tells rows apart, to draw subsamples by."""
    return [c for c in KEYS if c in df.columns]


def _fit(rows: DataFrame, target: str, features: Sequence[str], trials: Sequence[Trial], validation: Column, **stops):
    bins = fit_bins(rows.filter(~validation), features, _categorical(features))
    packed = binned(rows, bins, target, _identity(rows), validation)
    return bins, packed, boost(packed, bins, trials, **stops)


def train_gbt(split: DataFrame, target: str, features: Sequence[str], trial: Trial = Trial(), patience: int = PATIENCE) -> Fitted:
    """Find the number of rounds with early stopping on val, refit on train + val, predict test.

    Missing values and categories that training has not seen go where each split sends them; nothing is imputed. Without
    val rows all ``max_iter`` rounds are run.
    """
    rows = store(split, "model-rows")
    known = rows.filter(F.col("split") != "test")
    _, _, (probe,) = _fit(known, target, features, [trial], F.col("split") == "val", patience=patience)
    bins, packed, (final,) = _fit(known, target, features, [replace(trial, max_iter=probe.rounds)], F.lit(False))
    model = Boosted(bins, training_mean(packed), final.trees)
    carried = [c for c in [*KEYS, "name", "starting_tier", target] if c in split.columns]
    encoded = [c for c in ("sex_encoded", "ipf_wc_numeric") if c in split.columns]
    predictions = model.predictions(rows.filter(F.col("split") == "test"), [*carried, *encoded])
    return Fitted(predictions, model, probe.rounds)


def param_search(
    split: DataFrame, target: str, features: Sequence[str], trials: Sequence[Trial], patience: int = PATIENCE, warmup: int = WARMUP
) -> DataFrame:
    """Every trial's state and its least validation error on the one temporal split, best first.

    All trials share the passes over the rows. From ``warmup`` rounds on, trials above the median are pruned; what
    a pruned trial shows is its best until then.
    """
    rows = store(split.filter(F.col("split") != "test"), "search-rows")
    _, packed, found = _fit(rows, target, features, trials, F.col("split") == "val", patience=patience, warmup=warmup)
    spread = packed.filter("val").agg(F.var_pop("y")).first()[0]
    out = []
    for number, p in enumerate(found):
        mse, mae = p.errors[p.rounds] if len(p.errors) > p.rounds else (None, None)
        t = p.trial
        r2 = 1 - mse / spread if mse is not None and spread else None
        out.append(
            (number, t.max_depth, t.step_size, t.subsample, t.feature_share, float(t.min_child_weight), t.l2, t.l1, t.gamma)
            + (t.max_iter, p.rounds, p.state, mse, None if mse is None else math.sqrt(mse), mae, r2)
        )
    schema = (
        "trial int, max_depth int, step_size double, subsample double, feature_share double, min_child_weight double, "
        "l2 double, l1 double, gamma double, drawn_rounds int, rounds int, state string, mse double, rmse double, mae double, r2 double"
    )
    return split.sparkSession.createDataFrame(out, schema).orderBy(F.col("mse").asc_nulls_last(), "trial")


def best_trial(found: DataFrame, trials: Sequence[Trial]) -> Trial:
    """The trial at the head of a search."""
    return trials[found.first()["trial"]]


def feature_importance(fitted: Fitted, spark, version: str = "") -> DataFrame:
    """Per feature: its share of the gain, the mean gain of its splits, how many, and whether it is unused."""
    gains = fitted.model.gains()
    whole = sum(total for total, _ in gains.values())
    rows = [(version, f, total / whole if whole else 0.0, total / n if n else 0.0, n, n == 0) for f, (total, n) in gains.items()]
    return spark.createDataFrame(rows, "version string, feature string, importance double, gain double, splits int, unused boolean")


def segment_dims(settings: Settings = SETTINGS) -> dict[str, Column]:
    """Dimensions of the segment report. F also holds Mx, both are encoded 0."""
    return {
        "sex": F.when(F.col("sex_encoded") == 1, "M").otherwise("F"),
        "weight_class": F.col("ipf_wc_numeric").cast("int"),
        "starting_tier": C.tier_name("starting_tier", settings),
    }


# --- two targets ----------------------------------------------------------------

TARGETS = ("pct_change_total", "pct_change_dots")


class Targets(NamedTuple):
    """What a fit of several targets gives; ``scores``, ``segments``, ``importances`` and ``searches`` name the target."""

    predictions: DataFrame
    scores: DataFrame
    segments: DataFrame
    importances: DataFrame
    searches: DataFrame | None


def dual_target(
    base: DataFrame,
    features: Sequence[str],
    targets: Sequence[str] = TARGETS,
    trial: Trial = Trial(),
    settings: Settings = SETTINGS,
    trials: Sequence[Trial] = (),
) -> Targets:
    """One fit per target on the same features and cut-offs, with its evaluation. Of ``trials`` the best one found is fitted."""
    spark = base.sparkSession
    shared_rows = base
    for target in targets:
        shared_rows = eligible_for_model(shared_rows, target, settings)
    cuts = store(split_dates(shared_rows, settings=settings), "cut-offs")
    predictions, tables = [], {"scores": [], "segments": [], "importances": [], "searches": []}
    for target in targets:
        split = store(temporal_split(model_frame(base, target, features, settings), cuts=cuts), f"split-{target}")
        chosen = trial
        if trials:
            found = store(param_search(split, target, features, trials), f"search-{target}")
            chosen = best_trial(found.orderBy(F.col("mse").asc_nulls_last(), "trial"), trials)
            tables["searches"].append(found)
        fitted = train_gbt(split, target, features, chosen)
        scored = store(fitted.predictions, f"predictions-{target}")
        summary = M.model_metrics(split, scored, target, "pred", len(features), len(trials) or 1)
        tables["scores"].append(summary.withColumn("rounds", F.lit(fitted.rounds)))
        dims = {d: c for d, c in segment_dims(settings).items() if d != "starting_tier" or "starting_tier" in scored.columns}
        tables["segments"].append(M.segment_metrics(scored, target, "pred", dims, settings))
        tables["importances"].append(feature_importance(fitted, spark))
        predictions.append(scored.select(*KEYS, F.col("pred").alias(f"pred_{target}"), "starting_tier"))
    stacked = {name: _by_target(found, targets) for name, found in tables.items()}
    return Targets(M.prediction_table(*predictions, KEYS, ["starting_tier"]), **stacked)


def _by_target(tables: Sequence[DataFrame], targets: Sequence[str]) -> DataFrame | None:
    out = None
    for table, target in zip(tables, targets):
        named = table.withColumn("target", F.lit(target))
        out = named if out is None else out.unionByName(named)
    return out


def compare_versions(scores: Mapping[str, DataFrame], target: str) -> DataFrame:
    """Stack the metrics of several versions into the table ``version_comparison`` reads."""
    stacked = None
    for version, table in scores.items():
        rows = table.withColumns({"version": F.lit(version), "target": F.lit(target)})
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return M.version_comparison(stacked)
