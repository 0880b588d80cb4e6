"""Descriptive tables over the base layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.functions.columns import experience_level, tier, tier_name
from tracklane.operators.clean import known_segment
from tracklane.operators.positions import group_quantiles, quartiles

SEGMENT = ["sex", "ipf_weight_class"]
PROGRESS = [f"{m}_progress" for m in ("squat", "bench", "deadlift", "total", "wilks")]


def add_experience_level(df: DataFrame, event_no: str = "cumulative_comps", settings: Settings = SETTINGS) -> DataFrame:
    return df.withColumn("experience_level", experience_level(event_no, settings))


def progress_summary(df: DataFrame, groups: Sequence[str], interpolation: str = "nearest") -> DataFrame:
    """Quartiles of every rate per group, over rows whose total has a rate."""
    rows = df.filter(F.col("total_progress").isNotNull())
    columns = {c: quartiles(f"{c}_p25", f"{c}_median", f"{c}_p75", interpolation) for c in PROGRESS}
    return group_quantiles(rows, groups, columns, {"sample_size": PROGRESS[0]})


def progress_by_segment(df: DataFrame, interpolation: str = "nearest") -> DataFrame:
    out = progress_summary(known_segment(df), SEGMENT, interpolation)
    return out.orderBy(F.asc("sex"), F.desc("total_progress_median"))


def progress_by_experience(df: DataFrame, interpolation: str = "nearest") -> DataFrame:
    return progress_summary(add_experience_level(df), ["experience_level"], interpolation).orderBy("experience_level")


def progress_by_segment_and_experience(df: DataFrame, interpolation: str = "nearest") -> DataFrame:
    groups = [*SEGMENT, "experience_level"]
    return progress_summary(add_experience_level(known_segment(df)), groups, interpolation).orderBy(*groups)


def null_rates(df: DataFrame, threshold: float = SETTINGS.null_rate_threshold) -> DataFrame:
    """Share of nulls per column, for columns above ``threshold``; one pass."""
    shares = df.agg(*[F.expr(f"avg(CAST(`{c}` IS NULL AS DOUBLE)) AS `{c}`") for c in df.columns])
    listed = shares.unpivot([], df.columns, "column", "rate").filter(F.col("rate") > threshold)
    return listed.select("column", F.round("rate", 4).alias("null_rate"))


def quality_report(df: DataFrame, entity: str = "primary_key", date: str = "date") -> DataFrame:
    """Metric and value, as text: rows, entities, date range, mean rows per entity, null rates."""
    # Entities are counted from one row per entity, so no distinct set is built.
    per_entity = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last")
    )
    summary = per_entity.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("entities"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.round(F.avg("n"), 2).alias("mean"),
    )
    scalars = {
        "total_records": "rows",
        "unique_lifters": "entities",
        "date_range_start": "first",
        "date_range_end": "last",
        "mean_comps_per_lifter": "mean",
    }
    entries = [F.struct(F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for m, c in scalars.items()]
    rates = null_rates(df).agg(F.sort_array(F.collect_list(F.struct("column", "null_rate"))).alias("rates"))
    rates = rates.select(
        F.lit("columns_with_gt_1pct_nulls").alias("metric"), F.to_json(F.map_from_entries("rates")).alias("value")
    )
    return summary.select(F.inline(F.array(*entries))).unionByName(rates)


def score_norms(df: DataFrame, score: str = "dots", groups: Sequence[str] = SEGMENT) -> DataFrame:
    """Mean and sample deviation of a score per segment, to hold against published norms."""
    return df.groupBy(*groups).agg(
        F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"), F.count(score).alias("sample_size")
    )


def tier_transitions(
    df: DataFrame, entity: str = "primary_key", score: str = "dots", settings: Settings = SETTINGS
) -> DataFrame:
    """Entities by starting tier and highest tier reached; flags small starting tiers."""
    reached = (
        df.groupBy(entity)
        .agg(F.max("starting_tier").alias("starting_tier"), tier(F.max(score), settings).alias("max_tier"))
        .filter(F.col("starting_tier").isNotNull())
    )
    counts = reached.groupBy("starting_tier").agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.count_if(F.col("max_tier") == t).alias(f"to_{t}") for t in range(len(settings.tier_names))],
    )
    named = counts.withColumns(
        {"tier": tier_name("starting_tier", settings), "too_few": F.col("entities") < settings.min_segment_rows}
    )
    return named.orderBy("starting_tier")
