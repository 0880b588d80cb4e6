"""Exact ranks and quantiles of groups of any size.

Values are put into fixed buckets whose order is the order of the values. The
counts per bucket are small whatever the group's size, and tell which bucket
holds a rank; only inside a bucket are values sorted. Nothing is sampled and
no group is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklane.operators.history import hot_entities
from tracklane.runtime import store



@dataclass(frozen=True, order=True)
class Quantile:
    """``linear`` interpolates between neighbours, ``nearest`` picks row ``round((n - 1) q)``."""

    q: float
    interpolation: str = "linear"

    def ranks(self, n: Column) -> tuple[Column, Column, Column]:
        """Lower rank, upper rank (0-based) and the share of the way between them."""
        exact = (n - 1) * F.lit(self.q)
        if self.interpolation == "linear":
            low = F.floor(exact)
            return low, F.ceil(exact), exact - low
        if self.interpolation == "nearest":
            nearest = F.floor(exact + 0.5)
            return nearest, nearest, F.lit(0.0)
        raise ValueError(f"unknown interpolation {self.interpolation!r}")


MEDIAN = Quantile(0.5)


def quartiles(low: str, median: str, high: str, interpolation: str = "nearest") -> dict[str, Quantile]:
    """Outer quartiles by ``interpolation``; a median is always the middle of the two middle rows."""
    return {low: Quantile(0.25, interpolation), median: MEDIAN, high: Quantile(0.75, interpolation)}


# Buckets per doubling of the value: neighbouring buckets differ by 0.07 %.
BUCKETS_PER_OCTAVE = 1024


def bucket_of(x: Column) -> Column:
    """Bucket number, non-decreasing in ``x``: logarithmic on both sides of zero, NaN above all."""
    # Offset beyond the exponent range of doubles keeps each side's sign.
    size = F.floor((F.log2(F.abs(x)) + 1100) * BUCKETS_PER_OCTAVE)
    return F.when(x == 0, F.lit(0)).when(F.isnan(x), F.lit(2**63 - 1)).when(x < 0, -size).otherwise(size)


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``on`` where null matches null, keeping the left copy of the keys."""
    # A struct is never null itself, and its null fields compare as equal.
    right = lookup.select(F.struct(*on).alias("_key"), *[c for c in lookup.columns if c not in on])
    return df.withColumn("_key", F.struct(*on)).join(right, "_key", how).drop("_key")


def value_positions(df: DataFrame, groups: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per group and distinct non-null value.

    ``copies`` rows carry the value, ``before`` rows of the group are smaller and
    ``size`` rows have a value at all. With a ``weight`` a row counts as so many; one
    of weight 0 asks for the position of its value and moves no other.
    """
    group = F.struct(*groups).alias("_group")  # null group keys form one group
    distinct = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, F.col(value))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("copies"))
        .withColumn("_bucket", bucket_of(F.col(value).cast("double")))
    )
    counts = distinct.groupBy("_group", "_bucket").agg(F.sum("copies").alias("_in_bucket"))
    counts = counts.select(
        "_group",
        "_bucket",
        F.coalesce(F.sum("_in_bucket").over(_below(["_group"], "_bucket")), F.lit(0)).alias("_start"),
        F.sum("_in_bucket").over(Window.partitionBy("_group")).alias("size"),
    )
    inside = F.coalesce(F.sum("copies").over(_below(["_group", "_bucket"], value)), F.lit(0))
    # The values lie by group and bucket already. There are as many counts as buckets hold values: a broadcast would take
    # them through the driver.
    placed = distinct.withColumn("_inside", inside).join(counts.hint("merge"), ["_group", "_bucket"])
    return placed.select("_group.*", value, "copies", (F.col("_start") + F.col("_inside")).alias("before"), "size")


def percentile_ranks(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """One row per group, measure and value: average rank over the group's count, times 100.

    ``values`` names the measures; one pass ranks all of them.
    """
    entries = [F.struct(F.lit(name).alias("measure"), v.cast("double").alias("value")) for name, v in values.items()]
    long = df.select(*groups, F.inline(F.array(*entries)))
    placed = value_positions(long, [*groups, "measure"], "value")
    average_rank = F.col("before") + (F.col("copies") + 1) / 2
    return placed.select(*groups, "measure", "value", (average_rank / F.col("size") * 100).alias("percentile"))


def lookup_percentile(
    df: DataFrame, ranks: DataFrame, measure: str, groups: Sequence[str], value: str, out: str
) -> DataFrame:
    """Attach the percentile of ``value`` in the group named by the columns ``groups``; null has none."""
    names = [c for c in ranks.columns if c not in ("measure", "value", "percentile")]
    of_measure = ranks.filter(F.col("measure") == measure).select(
        *[F.col(n).alias(g) for n, g in zip(names, groups)], F.col("value").alias(value), F.col("percentile").alias(out)
    )
    return lookup_join(df, of_measure, [*groups, value])


def add_percentile_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    ranks = store(percentile_ranks(df, groups, {out: F.col(value)}), "percentile-ranks")
    return lookup_percentile(df, ranks, out, groups, value, out)


def percentile_ranks_asof(df: DataFrame, groups: Sequence[str], date: str, values: Mapping[str, Column]) -> DataFrame:
    """One row per group, date, measure and value: the percentile among the rows up to that date, which counts in.

    The days up to a date are a union of dyadic intervals, one per set bit of their
    number. A row is counted in the interval of each size that holds its day and asks
    the intervals its own date is made of, so a rank costs a factor of the logarithm of
    the days and no join of rows with rows. Each interval is ranked as a group of
    ``value_positions``, so neither a group nor an interval is sorted in one task. Only
    the first and last date reach the driver: ranks and positions grow with the rows, and
    small as they are when compressed they are never broadcast. Rows without a date are not ranked.
    """
    entries = [F.struct(F.lit(name).alias("measure"), v.cast("double").alias("value")) for name, v in values.items()]
    long = df.select(F.struct(*groups).alias("_key"), F.col(date).cast("date").alias("_date"), F.inline(F.array(*entries)))
    counted = long.filter("_date IS NOT NULL AND value IS NOT NULL").groupBy("_key", "_date", "measure", "value")
    points = store(counted.agg(F.count(F.lit(1)).alias("_rows")), "asof-points")
    first, last = points.agg(F.min("_date"), F.max("_date")).first()
    days = 1 if first is None else (last - first).days + 1
    levels = F.array(*[F.lit(n) for n in range(days.bit_length())])

    upto = F.datediff("_date", F.lit(first).cast("date")) + 1  # days from the first to this one
    at = lambda level: F.call_function("shiftright", upto, level)
    counts_in = F.transform(
        levels,
        lambda n: F.struct(
            n.alias("level"),
            F.call_function("shiftright", upto - 1, n).alias("interval"),
            F.lit(None).cast("date").alias("asked"),
            F.col("_rows").alias("weight"),
        ),
    )
    asks = F.transform(
        F.filter(levels, lambda n: at(n) % 2 == 1),
        lambda n: F.struct(
            n.alias("level"), (at(n) - 1).alias("interval"), F.col("_date").alias("asked"), F.lit(0).cast("long").alias("weight")
        ),
    )
    interval = ["_key", "measure", "level", "interval"]
    spread = points.select("_key", "measure", "value", F.inline(F.concat(counts_in, asks)))
    placed = value_positions(spread, interval, "value", F.col("weight"))
    asked = spread.filter("asked IS NOT NULL").select(*interval, "value", "asked")
    found = asked.join(placed.hint("merge"), [*interval, "value"]).groupBy("_key", "asked", "measure", "value")
    sums = found.agg(*[F.sum(c).alias(c) for c in ("before", "copies", "size")])
    percentile = (F.col("before") + (F.col("copies") + 1) / 2) / F.col("size") * 100
    return sums.select("_key.*", F.col("asked").alias(date), "measure", "value", percentile.alias("percentile"))


def add_percentile_rank_asof(df: DataFrame, groups: Sequence[str], date: str, value: str, out: str) -> DataFrame:
    ranks = store(percentile_ranks_asof(df, groups, date, {out: F.col(value)}), "percentile-ranks")
    return lookup_percentile(df, ranks.hint("merge"), out, [*groups, date], value, out)


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    columns: Mapping[str, Mapping[str, Quantile]],
    counts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact quantiles per group, one output row per group.

    ``columns`` maps a column to ``{output name: Quantile}``; ``counts`` maps an
    output name to a column of ``columns`` whose non-null rows are counted.

    Two narrow scans. The first counts rows per bucket; the second keeps only the
    buckets that hold a wanted rank, so a small share of the values is shuffled.
    """
    groups, names = list(groups), list(columns)
    wanted_quantiles = sorted({q for outs in columns.values() for q in outs.values()})
    keys = [*groups, "_col"]

    entries = [F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in names]
    values = df.select(*groups, F.inline(F.array(*entries)))
    values = values.withColumn("_bucket", bucket_of(F.col("_x")))

    buckets = values.groupBy(*keys, "_bucket").agg(F.count("_x").alias("_in_bucket"))
    buckets = buckets.select(
        *keys,
        "_bucket",
        "_in_bucket",
        F.coalesce(F.sum("_in_bucket").over(_below(keys, "_bucket")), F.lit(0)).alias("_start"),
        F.sum("_in_bucket").over(Window.partitionBy(*keys)).alias("_n"),
    )
    ranks = {q: q.ranks(F.col("_n")) for q in wanted_quantiles}
    start, end = F.col("_start"), F.col("_start") + F.col("_in_bucket")
    holds_one = F.col("_n") == 0  # a group without values keeps its output row
    for low, high, _ in ranks.values():
        holds_one = holds_one | ((low >= start) & (low < end)) | ((high >= start) & (high < end))
    wanted = store(buckets.filter(holds_one).drop("_in_bucket"), "quantile-buckets")

    found = lookup_join(values, wanted, [*keys, "_bucket"], "inner")
    found = found.groupBy(*keys, "_bucket", "_x", "_start", "_n").agg(F.count(F.lit(1)).alias("_copies"))
    inside = F.coalesce(F.sum("_copies").over(_below([*keys, "_bucket"], "_x")), F.lit(0))
    found = found.withColumn("_from", F.col("_start") + inside)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_copies")), F.col("_x")))

    picked = [F.max("_n").alias("_n")]
    for i, (low, high, _) in enumerate(ranks.values()):
        picked += [at(low).alias(f"_low{i}"), at(high).alias(f"_high{i}")]
    per_column = found.groupBy(*keys).agg(*picked)
    quantile = {
        q: F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * share
        for i, (q, (_, _, share)) in enumerate(ranks.items())
    }
    wide = []
    for c, outs in columns.items():
        for out, q in outs.items():
            wide.append(F.max(F.when(F.col("_col") == c, quantile[q])).alias(out))
    for out, c in (counts or {}).items():
        wide.append(F.coalesce(F.max(F.when(F.col("_col") == c, F.col("_n"))), F.lit(0)).alias(out))
    return per_column.groupBy(*groups).agg(*wide)


def entity_median(df: DataFrame, entity: str, value: str, out: str, **limits: int) -> DataFrame:
    """Median per entity: the built-in aggregate, but bucketed for the largest entities."""
    hot = hot_entities(df, entity, **limits)
    if hot.isEmpty():
        return df.groupBy(entity).agg(F.median(value).alias(out))
    hot = F.broadcast(hot)  # at most max_hot keys
    others = df.join(hot, entity, "left_anti").groupBy(entity).agg(F.median(value).alias(out))
    largest = group_quantiles(df.join(hot, entity, "left_semi"), [entity], {value: {out: MEDIAN}})
    return others.unionByName(largest)


def _below(partition: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
