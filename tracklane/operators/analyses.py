"""Analysis tables over the base layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.functions.columns import ratio, tenure_bucket, tenure_order
from tracklane.operators.clean import known_segment
from tracklane.operators.describe import SEGMENT, add_experience_level
from tracklane.operators.history import PanelKeys, Running, split_hot, with_history
from tracklane.operators.positions import MEDIAN, entity_median, group_quantiles, quartiles
from tracklane.runtime import store

KEYS = PanelKeys("primary_key", "date", "meet_name")
BY_EVENT = [*SEGMENT, "cumulative_comps"]


def _early_events(df: DataFrame, settings: Settings) -> DataFrame:
    return known_segment(df).filter(F.col("cumulative_comps") <= settings.max_event_no)


def career_trajectory(df: DataFrame, interpolation: str = "nearest", settings: Settings = SETTINGS) -> DataFrame:
    """Quartiles of the total per segment and tenure bucket, buckets in order of length."""
    rows = known_segment(df).filter(F.col("tenure").isNotNull())
    rows = rows.withColumns(
        {"tenure_bucket": tenure_bucket("tenure", settings), "tenure_order": tenure_order("tenure", settings)}
    )
    out = group_quantiles(
        rows,
        [*SEGMENT, "tenure_bucket", "tenure_order"],
        {"total": quartiles("total_p25", "median_total", "total_p75", interpolation)},
        {"sample_size": "total"},
    )
    return out.orderBy(*SEGMENT, "tenure_order")


def indexed_growth(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Median of each measure by event number."""
    measures = ("total", "squat", "bench", "deadlift")
    columns = {m: {f"median_{m}": MEDIAN} for m in measures}
    return group_quantiles(_early_events(df, settings), BY_EVENT, columns, {"sample_size": "total"}).orderBy(*BY_EVENT)


def percentile_movement(df: DataFrame, interpolation: str = "nearest", settings: Settings = SETTINGS) -> DataFrame:
    rank = "total_percentile_rank"
    rows = _early_events(df, settings).filter(F.col(rank).isNotNull())
    spread = quartiles("percentile_rank_p25", "median_percentile_rank", "percentile_rank_p75", interpolation)
    return group_quantiles(rows, BY_EVENT, {rank: spread}, {"sample_size": rank}).orderBy(*BY_EVENT)


def rolling_summary(df: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    rows = _early_events(df, settings).filter(F.col("rolling_avg_total_3").isNotNull())
    columns = {f"rolling_avg_{m}_3": {f"median_rolling_{m}": MEDIAN} for m in ("total", "squat", "bench", "deadlift")}
    return group_quantiles(rows, BY_EVENT, columns, {"sample_size": "rolling_avg_total_3"}).orderBy(*BY_EVENT)


def part_ratios(df: DataFrame) -> DataFrame:
    """Median share of each lift by experience level."""
    groups = [*SEGMENT, "experience_level"]
    rows = add_experience_level(known_segment(df).filter(F.col("squat_ratio").isNotNull()))
    columns = {f"{p}_ratio": {f"median_{p}_ratio": MEDIAN} for p in ("squat", "bench", "deadlift")}
    return group_quantiles(rows, groups, columns, {"sample_size": "squat_ratio"}).orderBy(*groups)


def score_trajectory(
    df: DataFrame, score: str = "wilks", interpolation: str = "nearest", settings: Settings = SETTINGS
) -> DataFrame:
    rows = _early_events(df, settings).filter(F.col(score).isNotNull())
    spread = quartiles(f"{score}_p25", f"median_{score}", f"{score}_p75", interpolation)
    return group_quantiles(rows, BY_EVENT, {score: spread}, {"sample_size": score}).orderBy(*BY_EVENT)


def milestone_attainment(
    df: DataFrame, keys: PanelKeys = KEYS, mode: str = "running_max", settings: Settings = SETTINGS
) -> DataFrame:
    """Share of a segment's entities whose best total reaches each milestone by event number.

    ``running_max``: entities at or above the milestone *at* event N, then the
    running maximum of that count over N. ``cumulative``: entities that reached it
    at event N or earlier while in the segment. One pass serves all milestones.
    """
    rows = _early_events(df, settings)
    rows = with_history(split_hot(rows, keys), keys, running=[Running("_best", "max", F.col("total"))])
    rows = rows.filter(F.col("total").isNotNull() | (mode == "cumulative"))

    totals = known_segment(_early_events(df, settings)).groupBy(*SEGMENT, keys.entity).agg(F.lit(1).alias("_one"))
    totals = totals.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("total_lifters"))

    levels = F.create_map(
        *[x for sex, kg in settings.milestones.items() for x in (F.lit(sex), F.array(*map(F.lit, kg)))]
    )
    reached = rows.withColumn("milestone_kg", F.explode(F.filter(levels[F.col("sex")], lambda m: F.col("_best") >= m)))
    group = [*SEGMENT, "milestone_kg"]
    upto = Window.partitionBy(*group).orderBy("cumulative_comps").rowsBetween(Window.unboundedPreceding, 0)
    if mode == "running_max":
        # An entity has one row per event number, so rows are entities.
        counts = reached.groupBy(*group, "cumulative_comps").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_reached", F.max("_n").over(upto))
    elif mode == "cumulative":
        first = reached.groupBy(*group, keys.entity).agg(F.min("cumulative_comps").alias("cumulative_comps"))
        counts = first.groupBy(*group, "cumulative_comps").agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_reached", F.sum("_n").over(upto))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return (
        counts.join(totals, SEGMENT)
        .select(*group, "cumulative_comps", ratio("_reached", "total_lifters").alias("fraction_reached"), "total_lifters")
        .orderBy(*group, "cumulative_comps")
    )


CAREER = ["total_comps", "career_tenure", "max_total", "max_wilks", "median_progress"]


def career_summary(df: DataFrame, entity: str = "primary_key") -> DataFrame:
    """One row per entity with a full career record."""
    rows = known_segment(df)
    careers = rows.groupBy(entity).agg(
        F.min("sex").alias("sex"),
        F.max("cumulative_comps").alias("total_comps"),
        F.max("tenure").alias("career_tenure"),
        F.max("total").alias("max_total"),
        F.max("wilks").alias("max_wilks"),
    )
    return careers.join(entity_median(rows, entity, "total_progress", "median_progress"), entity).na.drop("any")


def _squared(centre: Column) -> Column:
    """Squared distance of ``z`` from a centre."""
    apart = F.zip_with("z", centre, lambda a, b: (a - b) * (a - b))
    return F.aggregate(apart, F.lit(0.0), lambda total, x: total + x)


def _seeds(points: DataFrame, key: str, settings: Settings) -> list[list[list[float]]]:
    """First centres of every restart, a pass for each: drawn in proportion to the squared distance from those before.

    The largest of distance over an exponential draw is such a draw, so a pass takes one maximum per restart. The draw is
    made of 52 bits of an md5 of the key, the same in any engine.
    """
    centres: list[list[list[float]]] = [[] for _ in range(settings.cluster_restarts)]
    for seed in range(settings.clusters):
        picks = []
        for restart, before in enumerate(centres):
            name = F.concat_ws(":", F.col(key).cast("string"), F.lit(restart), F.lit(seed), F.lit(settings.cluster_seed))
            drawn = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
            far = F.array_min(F.transform(F.lit(before), _squared)) if seed else F.lit(1.0)
            picks.append(F.min(F.struct((far / F.log(drawn)).alias("w"), F.col(key).alias("k"), F.col("z"))).alias(f"p{restart}"))
        # One row of a column per restart: grouped by restart, the least of a struct would sort all points once per restart.
        for before, pick in zip(centres, points.agg(*picks).first()):
            before.append(list(pick["z"]))
    return centres


def _nearest(centres: Column) -> Column:
    """(distance, cluster) of the nearest centre, the first of equally near ones."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(_squared(c).alias("d"), i.alias("c"))))


def k_means(points: DataFrame, key: str, settings: Settings = SETTINGS) -> tuple[DataFrame, list[list[float]]]:
    """(key, z, cluster) and the centres of the best restart.

    All restarts move in the same pass: a row is assigned in each, and one aggregate gives the means of restarts x
    clusters. A cluster that loses its rows keeps its centre. Stops when no centre moves, after ``cluster_steps`` steps at the latest.
    """
    restarts, clusters = range(settings.cluster_restarts), range(settings.clusters)
    centres = _seeds(points, key, settings)
    size = len(centres[0][0])

    def assigned() -> DataFrame:
        at = F.transform(F.lit(centres), lambda c, r: F.struct(r.alias("restart"), _nearest(c).alias("at")))
        return points.select("z", F.inline(at)).select("z", "restart", F.col("at.c").alias("c"), F.col("at.d").alias("d"))

    means = [F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(size)]
    for _ in range(settings.cluster_steps):
        found = {(r["restart"], r["c"]): [r[f"m{i}"] for i in range(size)] for r in assigned().groupBy("restart", "c").agg(*means).collect()}
        moved = [[found.get((r, c), centres[r][c]) for c in clusters] for r in restarts]
        if moved == centres:
            break
        centres = moved
    costs = {r["restart"]: r["cost"] for r in assigned().groupBy("restart").agg(F.sum("d").alias("cost")).collect()}
    best = min(restarts, key=lambda r: (round(costs[r], 6), r))
    return points.select(key, "z", _nearest(F.lit(centres[best]))["c"].alias("cluster")), centres[best]


def archetypes(df: DataFrame, entity: str = "primary_key", settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """K-means on standardised careers: assignments, and centroids in original units.

    Clusters are numbered by the first key among their members, so the number does not depend on the
    restart that found them. Without careers both tables are empty.
    """
    careers = store(career_summary(df, entity), "careers")
    spread = careers.agg(*[f(c).alias(f"{n}_{c}") for c in CAREER for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [(F.col(c) - F.lit(spread[f"m_{c}"])) / F.lit(spread[f"s_{c}"] or 1.0) for c in CAREER]
    points = store(careers.select(entity, F.array(*scaled).cast("array<double>").alias("z")), "career-points")
    if points.isEmpty():
        none = careers.withColumn("cluster", F.lit(0)).limit(0)
        return none, none.select("cluster", *[F.col(c).cast("double").alias(c) for c in CAREER])
    assigned, centres = k_means(points, entity, settings)
    assigned = store(assigned.drop("z"), "clusters")
    first = assigned.groupBy("cluster").agg(F.min(entity).alias("first")).orderBy("first").collect()  # a row per cluster
    number = {r["cluster"]: i for i, r in enumerate(first)}
    renamed = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[F.col("cluster")]
    rows = [
        (n, *[float(v * (spread[f"s_{c}"] or 1.0) + spread[f"m_{c}"]) for v, c in zip(centres[old], CAREER)]) for old, n in number.items()
    ]
    schema = "cluster int, " + ", ".join(f"{c} double" for c in CAREER)
    return careers.join(assigned.withColumn("cluster", renamed), entity), df.sparkSession.createDataFrame(rows, schema)
