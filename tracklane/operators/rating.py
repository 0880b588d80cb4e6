"""Field-based rating: meet by meet, or period by period.

``meet_rating`` gives the order of a loop over contests by date, in one of two ways. A contest with one member
changes no rating: it takes the rating after its member's previous contest.

Windows: contests in their order are cut into runs of some ``WINDOW_ROWS`` rows. A task rates one window, contest
after contest, from the ratings its entities had before it; rounds follow the rows, however long the chains of contests
are. A contest larger than a window has one of its own, rated by all tasks.

Levels, for tables of few dates: a contest waits only for the previous contest of each of its members, so contests
are peeled into levels: level 0 waits for none, level n for one of level n - 1. All contests of a level are rated at
once; there are as many rounds as the longest chain of contests has links.

``field_rating`` is a definition of its own: inside a period all fields are rated from the ratings at its start.

In both a row needs from the past only the rating its entity had before; every rated row is
therefore written under the entity's *next* round, and a round reads just the rows addressed to
it. Work per round follows the rows of the round, not the number of entities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.operators.positions import bucket_of
from tracklane.runtime import new_path, ship, store

FILE_ROWS = 5_000_000
ROUND_ROWS = 250_000  # rows of a round that one task writes
WINDOW_ROWS = 200_000  # rows of contests that one task rates one after another, some 300 bytes each
BLOCK = 16  # rounds whose arriving rows share a folder; also dates up to which levels are few

PERIODS = ("day", "week", "month", "quarter", "year")


def field_rating(
    df: DataFrame,
    *,
    entity: str,
    date: str,
    field: Sequence[str],
    measure: str,
    tie: str,
    meet_type: str | None = None,
    period: str = "month",
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Add ``elo_rating`` (before the event), ``elo_change`` and ``meet_field_elo``.

    ``field`` names the columns of one contest within a period. All fields of a period start
    from the same ratings; ``meet_rating`` goes contest by contest.
    An entity twice in one field keeps the change of its highest position.
    """
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}, expected one of {PERIODS}")
    spark = df.sparkSession
    events_path, rated_path = new_path(spark, "rating-events"), new_path(spark, "rated")

    events = _contests(df, entity, date, list(field), measure, tie, meet_type, period, settings)
    events.hint("rebalance", "_period").write.partitionBy("_period").parquet(events_path)

    # One row per period: the calendar bounds what reaches the driver.
    stored = spark.read.parquet(events_path)
    rounds = stored.groupBy("_period").agg(
        F.count("_previous").alias("returning"),
        F.count(F.lit(1)).alias("rows"),
    )
    rounds = rounds.orderBy("_period").collect()
    writers = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = events.drop("_period").schema
    out_schema = None
    for row in rounds:
        contests = spark.read.schema(schema).parquet(f"{events_path}/_period={row['_period']}")
        if row["returning"]:
            arriving = spark.read.schema(out_schema).parquet(f"{rated_path}/_next={row['_period']}")
            ratings = _ratings_after(arriving, entity)
            contests = contests.join(ratings, entity, "left")
        else:
            contests = contests.withColumn("_rating", F.lit(None).cast("double"))
        rated = _rate(contests, settings)
        out_schema = rated.drop("_next").schema
        # A next period is written by one task per FILE_ROWS rows of the round.
        part = F.pmod(F.xxhash64(entity), F.lit(1 + row["rows"] // FILE_ROWS))
        rated.repartition(writers, "_next", part).write.mode("append").partitionBy("_next").parquet(rated_path)

    results = spark.read.schema(rated.schema).parquet(rated_path)
    return results.select(entity, date, tie, "elo_rating", "elo_change", "meet_field_elo")


def _scores(
    df: DataFrame, entity: str, date: str, tie: str, contest: Column, measure: str, meet_type: str | None, settings: Settings
) -> DataFrame:
    """The rows with their contest, measure and weight."""
    multiplier = F.lit(1.0)
    if meet_type:
        codes = F.create_map(*[F.lit(x) for kv in settings.rating_multiplier.items() for x in kv])
        fallback = settings.rating_multiplier[4]
        multiplier = F.coalesce(F.try_element_at(codes, F.col(meet_type)), F.lit(fallback))
    return df.select(
        entity,
        date,
        tie,
        contest.alias("_field"),
        F.coalesce(F.col(measure), F.lit(0.0)).alias("_measure"),
        (settings.rating_k * multiplier).alias("_k"),
    )


def _standings(rows: DataFrame, entity: str, date: str, tie: str) -> DataFrame:
    """Position and number of rows in the contest. They do not depend on ratings and are taken once, before the
    rounds: rows are numbered within a range of the measure, on top of the counts of the ranges below."""
    rows = rows.withColumn("_range", bucket_of(F.col("_measure")))
    ranges = rows.groupBy("_field", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    contest = Window.partitionBy("_field")
    below = contest.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "_field",
        "_range",
        F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_below"),
        F.sum("_rows").over(contest).alias("_size"),
    )
    inside = Window.partitionBy("_field", "_range").orderBy("_measure", entity, date, tie)
    rows = (
        rows.withColumn("_position", F.row_number().over(inside) - 1)
        .join(ranges, ["_field", "_range"])
        .withColumn("_position", F.col("_position") + F.col("_below"))
    )
    return rows.drop("_range", "_below")


def _contests(
    df: DataFrame,
    entity: str,
    date: str,
    field: list[str],
    measure: str,
    tie: str,
    meet_type: str | None,
    period: str,
    settings: Settings,
) -> DataFrame:
    """Everything about a contest that does not depend on ratings: score, size, weight, neighbours."""
    start = F.date_format(F.date_trunc(period, F.col(date)), "yyyy-MM-dd")
    contest = F.struct(start.alias("_period"), *[F.col(c) for c in field])
    rows = _standings(_scores(df, entity, date, tie, contest, measure, meet_type, settings), entity, date, tie)
    rows = rows.withColumn("_period", F.col("_field._period"))
    # One row per entity and period, so this window is as long as the calendar.
    timeline = Window.partitionBy(entity).orderBy("_period")
    neighbours = rows.select(entity, "_period").distinct()
    neighbours = neighbours.withColumns(
        {"_previous": F.lag("_period").over(timeline), "_next": F.lead("_period").over(timeline)}
    )
    return rows.join(neighbours, [entity, "_period"])


def contest_levels(edges: DataFrame) -> tuple[DataFrame, int]:
    """(contest, level) of every contest that waits for another, and the highest level.

    ``edges`` (before, contest) says which contest waits for which. What waits for nothing leaves with its edges;
    a contest's level is how often it has stayed. A pass reads only the edges that are left.
    """
    spark, path, level = edges.sparkSession, new_path(edges.sparkSession, "levels"), 0
    edges = store(edges, "edges")
    schema = edges.select("contest").schema
    while not edges.isEmpty():
        level += 1
        edges.select("contest").distinct().write.parquet(f"{path}/level={level}")
        waiting = spark.read.schema(schema).parquet(f"{path}/level={level}").withColumnRenamed("contest", "before")
        edges = store(edges.join(waiting, "before", "left_semi"), "edges")
    if not level:
        return spark.createDataFrame([], schema).withColumn("level", F.lit(0)), 0
    return spark.read.parquet(path).groupBy("contest").agg(F.max("level").alias("level")), level


def meet_rating(
    df: DataFrame,
    *,
    entity: str,
    date: str,
    field: Sequence[str],
    measure: str,
    tie: str,
    meet_type: str | None = None,
    settings: Settings = SETTINGS,
) -> DataFrame:
    """Add ``elo_rating`` (before the contest), ``elo_change`` and ``meet_field_elo``, contest by contest.

    A contest is a date and the ``field`` columns; contests follow each other by date, then by those
    columns in their order. An entity in two contests of a date goes through both, one after the other; twice
    in one contest, the change of its highest position stays. A null entity counts as one entity.
    Each round rates a window of contests, or a level where there are no more dates than windows.
    """
    spark = df.sparkSession
    contest = F.struct(*[F.col(c) for c in dict.fromkeys([date, *field])])
    rows = _standings(_scores(df, entity, date, tie, contest, measure, meet_type, settings), entity, date, tie)
    rows = store(rows.withColumn("_who", F.struct(F.col(entity))), "standings")
    several = rows.filter("_size > 1")
    contests = store(_in_order(several.select("_field", "_size").distinct(), date), "contests")

    # What an entity went through before and will go through next, contests of one left out.
    entries = rows.select("_who", "_field").distinct().join(contests.drop("_size"), "_field", "left")
    earlier = Window.partitionBy("_who").orderBy("_field").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_who").orderBy(F.desc("_field")).rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumns(
        {
            "_previous": F.last("_contest", True).over(earlier),
            "_following": F.last("_contest", True).over(later),
            "_next": F.last("_window", True).over(later),
        }
    )
    entries = store(entries, "entries")
    placed = several.join(entries, ["_who", "_field"])
    size = contests.agg(F.sum("_size").alias("rows"), F.countDistinct(F.col("_field").getField(date)).alias("dates")).first()
    if size["rows"] is None:
        rated = None
    elif _few_dates(size["dates"], size["rows"]):
        rated = _by_levels(placed.drop("_window", "_next"), entries, settings)
    else:
        rated = _by_windows(placed, entity, date, tie, settings)

    names = [entity, date, tie, "elo_rating", "elo_change", "meet_field_elo"]
    alone = rows.filter("_size = 1").join(entries.select("_who", "_field", "_previous"), ["_who", "_field"])
    if rated is None:
        alone = alone.withColumn("_rating", F.lit(None).cast("double"))
        return _rate(alone, settings, F.col("_rating")).select(*names)
    after = _ratings_after(rated, "_who", "_contest").withColumnRenamed("_contest", "_previous")
    alone = _rate(alone.join(after, ["_who", "_previous"], "left"), settings, F.col("_rating"))
    return rated.select(*names).unionByName(alone.select(*names))


def _few_dates(dates: int, rows: int) -> bool:
    """Whether levels, hardly more than dates, are few beside the windows."""
    return dates <= max(BLOCK, rows // WINDOW_ROWS)


def _in_order(contests: DataFrame, date: str) -> DataFrame:
    """Contests with the number of rows in contests before them, ``_contest``, and their window. A contest larger than
    a window follows the others of its window, in an odd one."""
    contests = contests.withColumn("_day", F.col("_field").getField(date))
    # One row per date, so the unpartitioned window is as long as the calendar.
    before = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)
    daily = contests.groupBy(F.col("_day").alias("_date")).agg(F.sum("_size").alias("_rows"))
    daily = daily.select("_date", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_earlier"))
    same_day = Window.partitionBy("_day").orderBy("_field").rowsBetween(Window.unboundedPreceding, -1)
    contests = contests.withColumn("_above", F.coalesce(F.sum("_size").over(same_day), F.lit(0)))
    contests = contests.join(daily, F.col("_day").eqNullSafe(F.col("_date")))
    contests = contests.select("_field", "_size", (F.col("_earlier") + F.col("_above")).alias("_contest"))
    large = (F.col("_size") > WINDOW_ROWS).cast("long")
    return contests.withColumn("_window", 2 * F.expr(f"_contest div {WINDOW_ROWS}") + large)


def _by_windows(placed: DataFrame, entity: str, date: str, tie: str, settings: Settings) -> DataFrame:
    """The rows of contests rated window by window."""
    spark = placed.sparkSession
    ship(spark)
    events_path, rated_path = new_path(spark, "rating-events"), new_path(spark, "rated")
    placed = placed.select(entity, date, tie, "_contest", "_position", "_size", "_k", "_next", "_window")
    placed.hint("rebalance", "_window").write.partitionBy("_window").parquet(events_path)
    schema, most = placed.drop("_window").schema, int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [entity, date, tie, "_contest", "_position", "_next", "elo_rating", "elo_change", "meet_field_elo"]
    sizes = spark.read.parquet(events_path).groupBy("_window").count().orderBy("_window").collect()  # one row per window
    results = None
    for window, rows in sizes:
        now = spark.read.schema(schema).parquet(f"{events_path}/_window={window}")
        arriving = spark.createDataFrame([], placed.select(entity).schema).withColumn("_rating", F.lit(None).cast("double"))
        if results is not None:
            stored = spark.read.schema(results).parquet(rated_path)
            arriving = stored.filter((F.col("_block") == window // BLOCK) & (F.col("_next") == window))
            arriving = arriving.select(entity, (F.col("elo_rating") + F.col("elo_change")).alias("_rating"))
        if window % 2:
            who = F.struct(F.col(entity))
            now = now.withColumns({"_who": who, "_field": F.col("_contest")})
            rated = _rate(now.join(arriving.select(who.alias("_who"), "_rating"), "_who", "left"), settings)
            highest = F.row_number().over(Window.partitionBy("_who").orderBy(F.desc("_position"))) == 1
            rated = rated.withColumn("_next", F.when(highest, F.col("_next"))).select(*names)
        else:
            rated = _rated_window(now, arriving, entity, names, settings)
        rated = rated.withColumn("_block", F.expr(f"_next div {BLOCK}"))
        if window % 2:
            rated = rated.repartition(min(most, 1 + rows // ROUND_ROWS), "_block", entity)
        results = rated.schema
        rated.write.mode("append").partitionBy("_block").parquet(rated_path)
    rated = spark.read.schema(results).parquet(rated_path)
    return rated.withColumns({"_who": F.struct(F.col(entity)), "_field": F.col("_contest")})


def _rated_window(now: DataFrame, arriving: DataFrame, entity: str, names: list[str], settings: Settings) -> DataFrame:
    """A window's rows rated in one task; an entity's last row of the window says where its rating is wanted next."""
    initial = settings.rating_initial

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        who = table[entity].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        contest, given = table["_contest"].fill_null(-1).to_numpy(), table["_rating"].to_numpy()
        ratings = np.full(int(who.max()) + 1, initial)
        ratings[who[contest < 0]] = given[contest < 0]

        rows = np.flatnonzero(contest >= 0)
        rows = rows[np.lexsort((table["_position"].fill_null(-1).to_numpy()[rows], contest[rows]))]
        table = table.take(pa.array(rows)).combine_chunks()
        who, contest = who[rows], contest[rows]
        begins = np.r_[True, contest[1:] != contest[:-1]]
        level = _levels(who, np.flatnonzero(begins), len(ratings))[np.cumsum(begins) - 1]
        rated = _rate_levels(*(table[c].to_numpy() for c in ("_position", "_size", "_k")), who, contest, level, ratings)

        last = np.full(len(ratings), -1)
        last[who] = np.arange(len(who))  # of repeated entities the last one stays
        leaves = np.zeros(len(who), dtype=bool)
        leaves[last[last >= 0]] = True
        columns = dict(zip(names[-3:], map(pa.array, rated)))
        columns["_next"] = pa.compute.if_else(pa.array(leaves), table["_next"], pa.scalar(None, pa.int64()))
        made = pa.table({c: columns[c] if c in columns else table[c] for c in names})
        yield from made.to_batches(max_chunksize=50_000)

    both = now.unionByName(arriving, allowMissingColumns=True)
    shown = both.withColumns({c: F.lit(0.0) for c in names[-3:]}).select(*names)
    return both.coalesce(1).mapInArrow(rate, shown.schema)


def _levels(who: np.ndarray, begins: np.ndarray, entities: int) -> np.ndarray:
    """Level of each contest; ``who`` are the members of the contests in their order, ``begins`` where each begins."""
    members, ends = who.tolist(), [*begins[1:].tolist(), len(who)]
    last, levels = [-1] * entities, []
    for a, b in zip(begins.tolist(), ends):
        own = members[a:b]
        level = 1 + max([last[m] for m in own])
        for m in own:
            last[m] = level
        levels.append(level)
    return np.array(levels)


def _rate_levels(
    position: np.ndarray, size: np.ndarray, k: np.ndarray, who: np.ndarray, contest: np.ndarray, level: np.ndarray, ratings: np.ndarray
) -> list[np.ndarray]:
    """Rating before, change and field mean of rows sorted by contest and position, level by level; updates ``ratings``."""
    out = [np.empty(len(who)) for _ in range(3)]
    order = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(level[order]) > 0, True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        now = order[a:b]
        own, field = who[now], contest[now]
        begins = np.r_[True, field[1:] != field[:-1]]
        before, n = ratings[own], size[now]
        first = np.flatnonzero(begins)
        mean = (np.add.reduceat(before, first) / n[first])[np.cumsum(begins) - 1]
        with np.errstate(over="ignore"):
            expected = 1.0 / (1.0 + 10.0 ** ((mean - before) / 400.0))
        change = k[now] * (position[now] / (n - 1) - expected)
        ratings[own] = before + change  # of an entity that comes twice, the change of its highest position stays
        for values, made in zip(out, (before, change, mean)):
            values[now] = made
    return out


def _by_levels(placed: DataFrame, entries: DataFrame, settings: Settings) -> DataFrame:
    """The rows of contests rated level by level."""
    spark = placed.sparkSession
    waits = entries.filter("_contest IS NOT NULL AND _previous IS NOT NULL")
    levels, _ = contest_levels(waits.select(F.col("_previous").alias("before"), F.col("_contest").alias("contest")).distinct())
    levels = store(levels, "levels")

    own = levels.select(F.col("contest").alias("_contest"), F.col("level").alias("_level"))
    following = levels.select(F.col("contest").alias("_following"), F.col("level").alias("_next"))
    placed = placed.join(own, "_contest", "left").join(following, "_following", "left")
    placed = placed.drop("_following", "_previous").withColumn("_level", F.coalesce("_level", F.lit(0)))
    events_path, rated_path = new_path(spark, "rating-events"), new_path(spark, "rated")
    placed.hint("rebalance", "_level").write.partitionBy("_level").parquet(events_path)
    schema, most = placed.drop("_level").schema, int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One row per level. Every task of a round writes a file for each block it has rows for, and each of the rounds of a
    # block reads its files: so a round has as many writers as its rows need, not as many as a shuffle has partitions.
    sizes = dict(spark.read.parquet(events_path).groupBy("_level").count().collect())
    results = None
    for level in range(len(sizes)):
        now = spark.read.schema(schema).parquet(f"{events_path}/_level={level}")
        if level:
            arriving = spark.read.schema(results).parquet(f"{rated_path}/_block={level // BLOCK}").filter(F.col("_next") == level)
            now = now.join(_ratings_after(arriving, "_who"), "_who", "left")
        else:
            now = now.withColumn("_rating", F.lit(None).cast("double"))
        rated = _rate(now, settings)
        results = rated.schema
        writers = min(most, 1 + sizes[level] // ROUND_ROWS)
        rated = rated.withColumn("_block", F.expr(f"_next div {BLOCK}")).repartition(writers, "_block", "_who")
        rated.write.mode("append").partitionBy("_block").parquet(rated_path)
    return spark.read.schema(results).parquet(rated_path)


def _ratings_after(rated: DataFrame, entity: str, *by: str) -> DataFrame:
    """Rating of each entity (and ``by``) after a round: one change per field, added over its fields."""
    per_field = rated.groupBy(entity, "_field", *by).agg(
        F.first("elo_rating").alias("_before"), F.max_by("elo_change", "_position").alias("_change")
    )
    return per_field.groupBy(entity, *by).agg(
        (F.first("_before") + F.coalesce(F.sum("_change"), F.lit(0.0))).alias("_rating")
    )


def _rate(contests: DataFrame, settings: Settings, mean: Column | None = None) -> DataFrame:
    """Rating before, change and mean rating of the field; ``mean`` gives the last where it is known."""
    rows = contests.withColumn("elo_rating", F.coalesce("_rating", F.lit(settings.rating_initial)))
    if mean is None:
        # averaged before the shuffle, so that a field's rows need not meet in one task
        means = rows.groupBy("_field").agg(F.avg("elo_rating").alias("meet_field_elo"))
        rows = rows.join(means, "_field")
    else:
        rows = rows.withColumn("meet_field_elo", F.coalesce(mean, "elo_rating"))
    rows = rows.drop("_rating")
    actual = F.try_divide(F.col("_position"), F.col("_size") - 1)
    expected = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("meet_field_elo") - F.col("elo_rating")) / 400.0))
    return rows.withColumn("elo_change", F.when(F.col("_size") > 1, F.col("_k") * (actual - expected)))
