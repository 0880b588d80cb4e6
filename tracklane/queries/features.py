"""The base layer and its feature families."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.config import SETTINGS
from tracklane.functions import columns as C
from tracklane.operators import features as P
from tracklane.operators.model import encode_categories, split_dates
from tracklane.operators.rating import field_rating
from tracklane.plans.base import (
    KEYS,
    RATING_COLUMNS,
    SEGMENT,
    SOURCE_SCORE,
    base_table,
    eligible_rows,
    history_features,
    past_rank_features,
    segment_features,
)
from tracklane.queries import sql
from tracklane.queries.layers import base_layer, meet_rated_layer, rated_layer, raw_layer, rounded
from tracklane.runtime import store
from tracklane.sources.schemas import BASE_INPUT, BASE_NAMES
from tracklane.sources.star_schema import table

KEY = ["primary_key", "date", "meet_name"]

# Output columns per family, with the digits both sides round doubles to.
FAMILIES: dict[str, list[str]] = {
    "row_features": [
        *["ipf_weight_class", "meet_type", "is_origin_country", "approx_age", "years_from_peak_age"],
        *["abs_years_from_peak_age", "total_per_bw", "dots", "squat_ratio", "bench_ratio", "deadlift_ratio"],
    ],
    "age_features": ["approx_age", "years_from_peak_age", "abs_years_from_peak_age"],
    "history_features": [
        *["cumulative_comps", "time_since_last_comp_days", "time_since_last_comp_years", "time_gap_category", "tenure"],
        *["years_competing", "log_cumulative_comps", "comps_per_year", "bodyweight_change", "prev_total_per_bw"],
        *[f"previous_{m}" for m in ("total", "squat", "bench", "deadlift", "wilks")],
        *[f"prev_{p}_ratio" for p in ("squat", "bench", "deadlift")],
        *[f"{p}rolling_avg_{m}_3" for p in ("", "prev_") for m in ("total", "squat", "bench", "deadlift")],
        *["prev_total_change_kg", "prev_rolling_std_total_3", "prev_personal_best_total", "prev_total_vs_pb"],
        *["prev_distance_from_pb", "squat_progress", "bench_progress", "deadlift_progress", "total_progress"],
        *["wilks_progress", "pct_change_total", "prev_total_progress", "prev_avg_progress_3", "prev_pct_change"],
    ],
    "dots_features": [
        *["dots", "previous_dots", "dots_progress", "pct_change_dots", "prev_pct_change_dots", "rolling_avg_dots_3"],
        *["prev_rolling_avg_dots_3", "prev_dots_personal_best", "prev_dots_vs_pb", "prev_distance_from_pb_dots"],
    ],
    "segment_features": [
        *["segment_mean_total", "total_vs_segment_mean", "prev_total_vs_segment_mean", "total_percentile_rank"],
        "prev_total_percentile_rank",
    ],
    "first_event": ["first_comp_dots", "first_comp_total_per_bw", "first_comp_age"],
    "first_event_percentile": ["first_comp_percentile_vs_sex_wc"],
    "career_so_far": ["max_dots_so_far", "best_growth_rate_so_far"],
    "growth_trend": ["dots_growth_trend"],
    "early_growth": ["early_growth_rate_dots_per_year"],
    "above_tier_counts": [f"comps_above_{n}_so_far" for n in ("intermediate", "advanced", "elite", "world_class")],
    "tiers": [
        *["starting_tier", "prev_tier", "max_tier_so_far", "tiers_climbed_so_far"],
        *["starting_tier_x_years_competing", "max_tier_x_time_gap"],
    ],
    "interactions": ["prev_total_x_time_gap", "prev_total_per_comp"],
}
_WHOLE = {
    *["cumulative_comps", "time_since_last_comp_days", "time_gap_category", "tenure", "ipf_weight_class", "meet_type"],
    *["is_origin_country", "approx_age", "years_from_peak_age", "abs_years_from_peak_age", "first_comp_age"],
    *FAMILIES["above_tier_counts"],
    *["starting_tier", "prev_tier", "max_tier_so_far", "tiers_climbed_so_far"],
}


def _family(columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(base_layer(spark, sf_dir).select(*KEY, *columns))

    return run


ALL_FEATURES = list(dict.fromkeys(c for cols in FAMILIES.values() for c in cols))


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole base layer, built from raw rather than read from the stored one."""
    return rounded(base_table(raw_layer(spark, sf_dir)).select(*KEY, *ALL_FEATURES))


def past_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two ranks of the base layer as they stood at the event."""
    rows = store(eligible_rows(raw_layer(spark, sf_dir)), "eligible")
    ranked = past_rank_features(store(history_features(rows), "history"))
    return rounded(ranked.select(*KEY, "prev_total_percentile_rank_asof", "first_comp_percentile_asof"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        C.ratio("l_extendedprice", "l_quantity").alias("unit_price"),
        C.ratio("l_tax", "l_discount").alias("tax_per_discount"),
    )
    return rounded(lines)


def experience_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base_layer(spark, sf_dir).select(
        C.experience_level("cumulative_comps").alias("experience_level"), C.experience_order("cumulative_comps").alias("step")
    )
    return rows.groupBy("experience_level", "step").agg(F.count(F.lit(1)).alias("n"))


def weight_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of part sizes, three quarters of a size unit each, by brand as the sex code."""
    part = table(spark, sf_dir, "part")
    sex = F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("Mx"), F.lit("X")), (F.col("p_size") % 4 + 1).cast("int"))
    bodyweight = F.col("p_size") * 2.5 + 10
    return part.select("p_partkey", sex.alias("sex"), bodyweight.alias("bodyweight")).withColumn(
        "weight_class", C.weight_class("sex", "bodyweight")
    )


def dots_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_layer(spark, sf_dir)
    score = C.dots("sex", "bodyweight_kg", "total_kg")
    scored = rows.select("name", "date", score.alias("dots"))
    return rounded(scored.withColumns({"tier": C.tier("dots"), "tier_name": C.tier_name(C.tier("dots"))}))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_categories(base_layer(spark, sf_dir)).select(
        *KEY, "sex_encoded", "age_class_encoded", "ipf_wc_numeric", "is_origin_country_int"
    )


LEAKAGE_PAIRS = {
    "previous_total": "total",
    "previous_dots": "dots",
    "previous_squat": "squat",
    "previous_bench": "bench",
    "previous_deadlift": "deadlift",
    "previous_wilks": "wilks",
    "prev_squat_ratio": "squat_ratio",
    "prev_bench_ratio": "bench_ratio",
    "prev_deadlift_ratio": "deadlift_ratio",
    "prev_rolling_avg_total_3": "rolling_avg_total_3",
    "prev_rolling_avg_squat_3": "rolling_avg_squat_3",
    "prev_rolling_avg_bench_3": "rolling_avg_bench_3",
    "prev_rolling_avg_deadlift_3": "rolling_avg_deadlift_3",
    "prev_rolling_avg_dots_3": "rolling_avg_dots_3",
    "prev_total_progress": "total_progress",
    "prev_pct_change": "pct_change_total",
    "prev_pct_change_dots": "pct_change_dots",
}


COUNTERS = {c: ("dots", bound) for c, bound in zip(FAMILIES["above_tier_counts"], SETTINGS.tier_bounds)}
CONSTANTS = ["first_comp_dots", "first_comp_total_per_bw", "first_comp_age", "first_comp_percentile_vs_sex_wc", "starting_tier"]
MAXIMA = {"prev_personal_best_total": "total", "prev_dots_personal_best": "dots", "max_dots_so_far": "dots"}


def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.leakage_report(base_layer(spark, sf_dir), KEYS, "cumulative_comps", LEAKAGE_PAIRS, COUNTERS, CONSTANTS, MAXIMA)


PAST_ONLY = re.compile(r"prev_|previous_|first_(?!name)|.*_so_far$")
DERIVED = {
    "prev_total_per_bw": lambda src: C.ratio(src("total"), "bodyweight"),
    "prev_total_change_kg": lambda src: src("total") - src("previous_total"),
    "prev_rolling_std_total_3": lambda src: C.std_of(
        [src("previous_total") - src("prev_total_change_kg"), src("previous_total"), src("total")], 2
    ),
    "prev_total_vs_pb": lambda src: C.ratio(src("total"), "prev_personal_best_total"),
    "prev_distance_from_pb": lambda src: F.col("prev_personal_best_total") - src("total"),
    "prev_dots_vs_pb": lambda src: C.ratio(src("dots"), "prev_dots_personal_best"),
    "prev_distance_from_pb_dots": lambda src: F.col("prev_dots_personal_best") - src("dots"),
    "prev_total_vs_segment_mean": lambda src: C.ratio(src("total"), "segment_mean_total"),
    "prev_total_x_time_gap": lambda src: src("total") * F.col("time_since_last_comp_years"),
    "prev_total_per_comp": lambda src: C.ratio(src("total"), "cumulative_comps"),
    "prev_tier": lambda src: C.tier(src("dots")),
    "max_tier_so_far": lambda src: C.tier("max_dots_so_far"),
    "tiers_climbed_so_far": lambda src: C.tier("max_dots_so_far") - F.col("starting_tier"),
}


def leakage_rows(rows: DataFrame) -> DataFrame:
    """Every past-only column by its name: how many rows do not follow from the event before, or ``unchecked``."""
    asked = sorted(c for c in rows.columns if PAST_ONLY.match(c))
    pairs = {**LEAKAGE_PAIRS, "prev_elo_change": "elo_change"}
    groups = [{k: v for k, v in g.items() if k in rows.columns} for g in (pairs, COUNTERS, MAXIMA, DERIVED)]
    pairs, counters, maxima, derived = groups
    reads = [c for c in ("total", "dots", "previous_total", "prev_total_change_kg") if c in rows.columns]
    constants = [c for c in CONSTANTS if c in rows.columns]
    found = P.leakage_report(
        rows, KEYS, "cumulative_comps", pairs, counters, constants, maxima, derived=derived, reads=reads, asked=asked
    )
    status = F.when(F.col("mismatches").isNull(), "unchecked").when(F.col("mismatches") > 0, "leak").otherwise("ok")
    return found.withColumn("status", status)


# What stands for other measures in an entity's last row.
CHANGED = ("squat", "bench", "deadlift", "total", "wilks")


def truncated(base: DataFrame) -> DataFrame:
    """Every past-only column against histories cut at the end of the training rows, and against changed last events."""
    cuts = store(split_dates(base), "cut-offs")
    full = base.filter(F.col("date") <= cuts.select("train_end").scalar())
    published = [c for c in (SOURCE_SCORE,) if c in full.columns]
    inputs = store(full.select(*[BASE_NAMES.get(c, c) for c in BASE_INPUT], *published), "cut-rows")
    ends = inputs.groupBy("primary_key").agg(F.max(F.struct("date", "meet_name")).alias("_end"))
    at_end = F.struct("date", "meet_name") == F.col("_end")
    other = inputs.join(ends, "primary_key").withColumns({c: F.when(at_end, F.col(c) * 2 + 1).otherwise(F.col(c)) for c in CHANGED}).drop("_end")
    columns = sorted(c for c in base.columns if PAST_ONLY.match(c))
    # Of over 100 columns only what the segment lookups read and what is compared is written.
    history = history_features(inputs)
    read = {*columns, *KEYS.order(), KEYS.entity, *SEGMENT, "cumulative_comps", "total", "dots"}
    history = store(history.select(*[c for c in history.columns if c in read or c.startswith("_first_")]), "cut-history")
    cut = store(segment_features(history).select(KEYS.entity, *KEYS.order(), *columns), "cut-features")
    return P.truncation_report(full, cut, history_features(other), KEYS, "cumulative_comps", columns)


def leakage_guard_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What knows later rows or its own event; ranks over the whole segment do, by definition."""
    return truncated(base_layer(spark, sf_dir))


def leakage_guard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and the cut histories for columns without a rule: no column stays unchecked."""
    found = leakage_rows(rated_layer(spark, sf_dir))
    cut = truncated(base_layer(spark, sf_dir)).select("feature", (F.col("from_later") + F.coalesce("from_own", F.lit(0))).alias("_cut"))
    mismatches = F.coalesce("mismatches", "_cut")
    status = F.when(mismatches.isNull(), "unchecked").when(mismatches > 0, "leak").otherwise("ok")
    return found.join(cut, "feature", "left").select("feature", mismatches.alias("mismatches"), status.alias("status"))


def rating(period: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rated = field_rating(
            base_layer(spark, sf_dir),
            entity="primary_key",
            date="date",
            field=SEGMENT,
            measure="total",
            tie="meet_name",
            meet_type="meet_type",
            period=period,
        )
        return rounded(rated, 4)

    return run


def rating_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating columns of the base layer, each meet a contest, in rounds of a quarter."""
    return rounded(rated_layer(spark, sf_dir).select(*KEY, *RATING_COLUMNS, "elo_gap_vs_field"), 4)


def rating_features_meets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating columns of the base layer, updated meet by meet over the whole table."""
    return rounded(meet_rated_layer(spark, sf_dir).select(*KEY, *RATING_COLUMNS, "elo_gap_vs_field"), 4)


QUERIES = {
    "base_features": base_features,
    **{name: _family(cols) for name, cols in FAMILIES.items()},
    "past_ranks": past_ranks,
    "ratios": ratios,
    "experience_level": experience_level,
    "weight_class": weight_class,
    "dots_score": dots_score,
    "encode_categories": encoded,
    "leakage_guard": leakage_guard,
    "leakage_guard_all": leakage_guard_all,
    "leakage_guard_cut": leakage_guard_cut,
    "elo_rating": rating("month"),
    "elo_rating_quarters": rating("quarter"),
    "rating_features": rating_features,
    "rating_features_meets": rating_features_meets,
}


def _select(columns: list[str]) -> str:
    cols = [f"CAST({c} AS INTEGER) AS {c}" if c in ("meet_type", "time_gap_category") else c if c in _WHOLE else sql.r(c) for c in columns]
    return sql.query(f"SELECT {', '.join(KEY)}, {', '.join(cols)} FROM base")


def _encode_sql() -> str:
    ages = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SETTINGS.age_class_midpoint.items())
    return sql.query(
        f"""SELECT {', '.join(KEY)}, CAST(CASE sex WHEN 'M' THEN 1 ELSE 0 END AS INTEGER) AS sex_encoded,
  CAST(CASE age_class {ages} END AS DOUBLE) AS age_class_encoded,
  CAST(CASE WHEN ipf_weight_class = 'unknown' THEN '0' ELSE replace(ipf_weight_class, '+', '') END AS DOUBLE) AS ipf_wc_numeric,
  CAST(is_origin_country AS INTEGER) AS is_origin_country_int FROM f0""",
        "f0",
    )


def _past_ranks_sql() -> str:
    """Every row beside the rows of its segment up to its date, and every first event beside the first events up to it."""

    def upto(rows: str, x: str, key: str) -> str:
        return f"""SELECT {key}, (count(*) FILTER (b.{x} < a.{x}) + (count(*) FILTER (b.{x} = a.{x}) + 1) / 2.0) / count(*) * 100 AS p
FROM (SELECT * FROM {rows} WHERE {x} IS NOT NULL) a JOIN (SELECT * FROM {rows} WHERE {x} IS NOT NULL) b
  ON a.sex IS NOT DISTINCT FROM b.sex AND a.ipf_weight_class IS NOT DISTINCT FROM b.ipf_weight_class AND b.date <= a.date
GROUP BY {key}"""

    return sql.query(
        f"""SELECT primary_key, date, meet_name, {sql.r('q.p', 'prev_total_percentile_rank_asof')},
  {sql.r('s.p', 'first_comp_percentile_asof')}
FROM f4 LEFT JOIN q USING (primary_key, date, meet_name) LEFT JOIN s USING (primary_key)""",
        "f4",
        q=upto("f4", "previous_total", "a.primary_key, a.date, a.meet_name"),
        first_rows="SELECT * FROM f4 WHERE cumulative_comps = 1",
        s=upto("first_rows", "dots", "a.primary_key"),
    )


def _leakage_sql() -> str:
    def off(c: str, want: str) -> str:
        return f"(abs(a.{c} - {want}) > 1e-9 OR (a.{c} IS NULL) <> (({want}) IS NULL))"

    rules = {c: off(c, f"b.{s}") for c, s in LEAKAGE_PAIRS.items()}
    for c, (source, bound) in COUNTERS.items():
        rules[c] = off(c, f"CASE WHEN b.primary_key IS NULL THEN 0 ELSE b.{c} + CASE WHEN b.{source} >= {bound} THEN 1 ELSE 0 END END")
    rules.update({c: f"b.primary_key IS NOT NULL AND {off(c, f'b.{c}')}" for c in CONSTANTS})
    rules.update({c: off(c, f"greatest(b.{c}, b.{s})") for c, s in MAXIMA.items()})
    tests = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {rule}) AS mismatches FROM base a LEFT JOIN base b "
        f"ON a.primary_key = b.primary_key AND a.cumulative_comps = b.cumulative_comps + 1"
        for c, rule in rules.items()
    )
    return sql.query(tests)


def _cut_sql() -> str:
    """The feature chain three times: over all rows, over those up to the cut, and with other measures in the last of them."""
    chain = ["eligible", "f0", "f1", "f2", "f3", "f4", "firsts", "base"]

    def copied(prefix: str) -> dict[str, str]:
        names = "|".join(chain)
        return {f"{prefix}_{n}": re.sub(rf"\b({names})\b", rf"{prefix}_\1", sql.CTES[n]) for n in chain[1:]}

    columns = sorted(c for c in ALL_FEATURES if PAST_ONLY.match(c))
    history = [c for c in columns if c not in ("first_comp_percentile_vs_sex_wc", "prev_total_percentile_rank", "prev_total_vs_segment_mean")]
    changed = ", ".join(f"CASE WHEN ending THEN {c} * 2 + 1 ELSE {c} END AS {c}" for c in CHANGED)
    off = lambda c, t: f"(abs(b.{c} - {t}.{c}) > 1e-6 OR (b.{c} IS NULL) <> ({t}.{c} IS NULL))"
    at_end = "b.cumulative_comps = n.n AND n.n > 1"
    both = " AND ".join(f"b.{k} = {{t}}.{k}" for k in KEY)
    tests = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {off(c, 't')}) AS from_later, "
        + (f"count(*) FILTER (WHERE {at_end} AND {off(c, 'o')})" if c in history else "CAST(NULL AS BIGINT)")
        + f" AS from_own FROM b JOIN cut_base t ON {both.format(t='t')} JOIN own_base o ON {both.format(t='o')} JOIN n ON b.primary_key = n.primary_key"
        for c in columns
    )
    return sql.query(
        tests,
        cut_at="SELECT (list(date ORDER BY date))[CAST(floor(count(*) * CAST(0.67 AS DOUBLE)) AS BIGINT) + 1] AS d FROM base",
        cut_eligible="SELECT * FROM eligible WHERE date <= (SELECT d FROM cut_at)",
        own_eligible=f"""SELECT * REPLACE ({changed}) FROM (SELECT *, row_number() OVER (PARTITION BY primary_key
  ORDER BY date DESC, meet_name DESC) = 1 AS ending FROM cut_eligible)""",
        **copied("cut"),
        **copied("own"),
        b="SELECT * FROM base WHERE date <= (SELECT d FROM cut_at)",
        n="SELECT primary_key, max(cumulative_comps) AS n FROM b GROUP BY primary_key",
    )


def _rating_sql(period: str) -> str:
    cols = ", ".join(sql.r(c, digits=4) for c in ("elo_rating", "meet_field_elo", "elo_change"))
    parts = sql.rating_parts(period, "sex, ipf_weight_class")
    return sql.query(f"SELECT primary_key, date, meet_name, {cols} FROM rated", "f0", recursive=True, **parts)


SQL = {
    "base_features": _select(ALL_FEATURES),
    **{name: _select(cols) for name, cols in FAMILIES.items()},
    "past_ranks": _past_ranks_sql(),
    "ratios": """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 6) AS unit_price,
  round(l_tax / nullif(l_discount, 0), 6) AS tax_per_discount FROM lineitem""",
    "experience_level": sql.query(
        f"""SELECT {sql.experience('cumulative_comps')} AS experience_level, CAST(CASE WHEN cumulative_comps <= 3 THEN 0
  WHEN cumulative_comps <= 8 THEN 1 WHEN cumulative_comps <= 15 THEN 2 ELSE 3 END AS INTEGER) AS step, count(*) AS n
FROM f1 GROUP BY 1, 2""",
        "f1",
    ),
    "weight_class": f"""SELECT *, {sql.weight_class_case('sex', 'bodyweight')} AS weight_class FROM (SELECT p_partkey,
  ['M', 'F', 'Mx', 'X'][p_size % 4 + 1] AS sex, CAST(p_size * 2.5 + 10 AS DOUBLE) AS bodyweight FROM part)""",
    "dots_score": sql.query(
        f"""SELECT name, date, round(dots, 6) AS dots, CAST({sql.tier('dots')} AS INTEGER) AS tier,
  ['Beginner', 'Intermediate', 'Advanced', 'Elite', 'World Class'][{sql.tier('dots')} + 1] AS tier_name
FROM (SELECT name, date, {sql.dots_case('sex', 'bodyweight_kg', 'total_kg')} AS dots FROM raw)""",
        "raw",
    ),
    "encode_categories": _encode_sql(),
    "leakage_guard": _leakage_sql(),
    "leakage_guard_cut": _cut_sql(),
    "elo_rating": _rating_sql("month"),
    "elo_rating_quarters": _rating_sql("quarter"),
    "rating_features_meets": sql.query(
        f"""SELECT primary_key, date, meet_name, {', '.join(sql.r(c, digits=4) for c in ('elo_rating', 'elo_change', 'meet_field_elo'))},
  round(lag(elo_change) OVER (PARTITION BY primary_key ORDER BY date, meet_name), 4) AS prev_elo_change,
  round(elo_rating - meet_field_elo, 4) AS elo_gap_vs_field FROM rated""",
        "f0",
        recursive=True,
        **sql.meet_rating_parts("date, meet_name, sex, ipf_weight_class"),
    ),
    "rating_features": sql.query(
        f"""SELECT primary_key, date, meet_name, {', '.join(sql.r(c, digits=4) for c in ('elo_rating', 'elo_change', 'meet_field_elo'))},
  round(lag(elo_change) OVER (PARTITION BY primary_key ORDER BY date, meet_name), 4) AS prev_elo_change,
  round(elo_rating - meet_field_elo, 4) AS elo_gap_vs_field FROM rated""",
        "f0",
        recursive=True,
        **sql.rating_parts("quarter", "meet_name, sex, ipf_weight_class"),
    ),
}
