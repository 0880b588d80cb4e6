"""Features of a segment as a whole: running means and percentile ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions.columns import ratio
from tracklane.operators.positions import lookup_join
from tracklane.runtime import store


def daily_prefix(df: DataFrame, groups: Sequence[str], date: str, value: str) -> DataFrame:
    """Per group and date: sum and count of ``value`` over all earlier dates.

    The window runs over one row per group and date, so the length of the
    calendar bounds it however many rows a segment has.
    """
    daily = df.groupBy(*groups, date).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(
        *groups, date, F.sum("_sum").over(earlier).alias("_sum_before"), F.sum("_n").over(earlier).alias("_n_before")
    )


def add_segment_mean(
    df: DataFrame,
    groups: Sequence[str],
    date: str,
    value: str,
    out: str,
    mode: str = "date",
    tie: str | None = None,
) -> DataFrame:
    """Expanding mean of ``value`` in the segment without the current row.

    ``date`` uses strictly earlier dates. ``row`` also uses the rows of the same
    date that come earlier by ``tie``.
    """
    before = store(daily_prefix(df, groups, date, value), "segment-days")
    joined = lookup_join(df, before, [*groups, date])
    total, n = F.col("_sum_before"), F.col("_n_before")
    if mode == "row":
        same_day = Window.partitionBy(*groups, date).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
        total, n = _plus(total, F.sum(value).over(same_day)), _plus(n, F.count(value).over(same_day))
    elif mode != "date":
        raise ValueError(f"unknown mode {mode!r}")
    return joined.withColumn(out, ratio(total, n)).drop("_sum_before", "_n_before")


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)
