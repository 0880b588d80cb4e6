"""Row filters, typing, repair and their drop counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings


def numeric_place(df: DataFrame, col: str = "place") -> DataFrame:
    """Keep rows with an all-digit place; drops disqualified, guest and null places."""
    return df.filter(F.col(col).rlike(r"^\d+$"))


def cast_types(df: DataFrame, date: str = "date", place: str = "place") -> DataFrame:
    return df.withColumns({date: F.to_date(F.col(date), "yyyy-MM-dd"), place: F.col(place).cast("bigint")})


def lower_case(df: DataFrame, col: str = "meet_name") -> DataFrame:
    return df.withColumn(col, F.lower(col))


def keep_event(df: DataFrame, event: str = "SBD", tested: str = "Yes", equipment: str = "Raw") -> DataFrame:
    return df.filter((F.col("event") == event) & (F.col("tested") == tested) & (F.col("equipment") == equipment))


def known_segment(df: DataFrame, sex: str = "sex", weight_class: str = "ipf_weight_class") -> DataFrame:
    return df.filter(F.col(sex).isin("M", "F") & (F.col(weight_class) != "unknown"))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(defaults))


def guard_short_gaps(
    df: DataFrame, cols: Sequence[str], gap_days: str = "time_since_last_comp_days", settings: Settings = SETTINGS
) -> DataFrame:
    """Null the rate columns of rows whose gap is under the minimum; an unknown gap keeps them."""
    return df.withColumns({c: short_gap_guard(F.col(c), F.col(gap_days), settings) for c in cols})


def short_gap_guard(rate: Column, gap_days: Column, settings: Settings = SETTINGS) -> Column:
    return F.when(gap_days < settings.min_gap_days, F.lit(None)).otherwise(rate)


# --- data quality ---------------------------------------------------------------


def all_parts_positive(parts: Sequence[str]) -> Column:
    rule = F.lit(True)
    for part in parts:
        rule = rule & (F.col(part) > 0)
    return rule


def parts_match_total(parts: Sequence[str], total: str, settings: Settings = SETTINGS) -> Column:
    summed = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return F.abs(summed - F.col(total)) <= settings.total_tolerance


def plausible_bodyweight(sex: str = "sex", bodyweight: str = "bodyweight", settings: Settings = SETTINGS) -> Column:
    """Inclusive range by sex. A sex without a range, or none, fails the rule."""
    rule = F.lit(False)
    for code, (low, high) in settings.bodyweight_range.items():
        rule = rule | ((F.col(sex) == code) & F.col(bodyweight).between(low, high))
    return rule


def quality_rules(settings: Settings = SETTINGS) -> dict[str, Column]:
    parts = ["squat", "bench", "deadlift"]
    return {
        "bombout": all_parts_positive(parts),
        "total_consistency": parts_match_total(parts, "total", settings),
        "bodyweight": plausible_bodyweight(settings=settings),
    }


def apply_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Keep rows for which every rule is true; null is not true."""
    for rule in rules.values():
        df = df.filter(rule)
    return df


def drop_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per rule, in the order applied: rows before, rows dropped and their share, in one pass."""
    passed, flags = F.lit(True), []
    for name, rule in rules.items():
        fails = ~F.coalesce(rule, F.lit(False))
        flags += [F.count_if(passed).alias(f"{name}_before"), F.count_if(passed & fails).alias(f"{name}_dropped")]
        passed = passed & ~fails
    entries = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("rule"),
            F.col(f"{name}_before").alias("rows_before"),
            F.col(f"{name}_dropped").alias("rows_dropped"),
            (F.try_divide(F.col(f"{name}_dropped"), F.col(f"{name}_before")) * 100).alias("pct_dropped"),
        )
        for i, name in enumerate(rules, 1)
    ]
    return df.agg(*flags).select(F.inline(F.array(*entries)))
