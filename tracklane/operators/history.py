"""Ordered per-entity history that also holds for entities too large for one task.

A plain ``Window.partitionBy(entity)`` sends all rows of an entity to one task.
Here the largest entities are split by day (by minute where rows carry a time)
into blocks, every window runs inside one (entity, block), and what a block must know
about earlier blocks - the last few rows and the running totals - comes from a
small table with one row per block. All other entities form a single block and
take no part in that table.

The result is the same as with plain windows. The cost is one column-pruned
count per entity, plus one exchange on (entity, block) for the rows themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_block"

# The largest entities by rows are split, if they have more than HOT_ROWS. Any
# entity beyond the first MAX_HOT holds under 1/MAX_HOT of all rows, so the list
# that is broadcast never needs to be longer.
MAX_HOT = 4096
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class PanelKeys:
    """Columns that place a row: whose it is, when, and what breaks ties on a date (``last`` those that remain)."""

    entity: str = "primary_key"
    date: str = "date"
    tie: str = "meet_name"
    last: str | None = None

    def order(self) -> list[str]:
        return [self.date, self.tie, *([self.last] if self.last else [])]


@dataclass(frozen=True)
class Running:
    """Running aggregate ``kind`` (sum, max, count, first) of ``value``.

    ``prior`` leaves the current row out.
    """

    name: str
    kind: str
    value: Column
    prior: bool = False


def hot_entities(df: DataFrame, entity: str, max_hot: int = MAX_HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """At most ``max_hot`` entities, the largest ones with more than ``hot_rows`` rows."""
    return (
        df.filter(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), entity)
        .limit(max_hot)
        .select(entity)
    )


def split_hot(df: DataFrame, keys: PanelKeys, max_hot: int = MAX_HOT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the block column: the day or minute for rows of a hot entity, null otherwise.

    Looks for hot entities first. Without any the column is a null literal, from
    which the planner sees that there are no blocks to carry anything over to.
    """
    hot = hot_entities(df, keys.entity, max_hot, hot_rows)
    has_time = df.schema[keys.date].dataType != T.DateType()
    block = F.date_trunc("minute", keys.date) if has_time else F.col(keys.date)
    if hot.isEmpty():
        return df.withColumn(BLOCK, F.when(F.lit(False), block))
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys.entity, "left")
    return marked.withColumn(BLOCK, F.when(F.col("_hot"), block)).drop("_hot")


def lag_name(col: str, k: int) -> str:
    return f"_lag{k}_{col}"


def with_history(
    df: DataFrame,
    keys: PanelKeys,
    lags: Mapping[str, int] | None = None,
    running: Sequence[Running] = (),
    event_no: str | None = None,
) -> DataFrame:
    """Add ``_lag<k>_<col>`` for k = 1..depth, running aggregates and the event number.

    ``df`` needs the block column of ``split_hot``. It should be a stored table
    or a cheap scan, since hot rows are read again for the block table.
    """
    lags = dict(lags or {})
    running = list(running)
    if event_no:
        running.append(Running(event_no, "count", F.lit(1)))
    inputs = {f"_in_{r.name}": r.value for r in running}
    source = df.withColumns(inputs)
    carry = _carry(source, keys, lags, running)

    block = f"PARTITION BY `{keys.entity}`, `{BLOCK}` ORDER BY {_names(keys.order())}"
    local = [f"row_number() OVER ({block}) AS _pos"]
    for col, depth in lags.items():
        local += [f"lag(`{col}`, {k}) OVER ({block}) AS _in{lag_name(col, k)}" for k in range(1, depth + 1)]
    for r in running:
        frame = f"{block} ROWS BETWEEN UNBOUNDED PRECEDING AND {'1 PRECEDING' if r.prior else 'CURRENT ROW'}"
        local.append(f"{r.kind}(`_in_{r.name}`) OVER ({frame}) AS `_local_{r.name}`")

    rows = source.selectExpr("*", *local)
    # Same keys as the window: the rows are not exchanged again for this join.
    rows = rows.join(carry, [keys.entity, BLOCK], "left")

    out = [f"`{c}`" for c in df.columns]
    for col, depth in lags.items():
        out += [f"{_combine_lag(col, k)} AS {lag_name(col, k)}" for k in range(1, depth + 1)]
    out += [f"{_combine_running(r)} AS `{r.name}`" for r in running]
    return rows.selectExpr(*out)


def _names(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def _carry(source: DataFrame, keys: PanelKeys, lags: Mapping[str, int], running: Sequence[Running]) -> DataFrame:
    """Per block of a hot entity: running totals of all earlier blocks and their last rows."""
    hot = source.filter(F.col(BLOCK).isNotNull())
    position = f"struct({_names(keys.order())})"

    def total(r: Running) -> str:
        value = f"`_in_{r.name}`"
        return f"min_by({value}, {position})" if r.kind == "first" else f"{r.kind}({value})"

    totals = [f"{total(r)} AS `_total_{r.name}`" for r in running]
    blocks = hot.groupBy(keys.entity, BLOCK).agg(F.expr("count(1) AS _rows"), *map(F.expr, totals))

    # One row per block of a hot entity: the length of the calendar bounds the window.
    earlier = f"PARTITION BY `{keys.entity}` ORDER BY {BLOCK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    combine = {"sum": "sum", "count": "sum", "max": "max", "first": "first"}
    prefix = blocks.selectExpr(
        f"`{keys.entity}`",
        BLOCK,
        f"sum(_rows) OVER ({earlier}) > 0 AS _has_prefix",
        *[f"{combine[r.kind]}(`_total_{r.name}`) OVER ({earlier}) AS `_before_{r.name}`" for r in running],
    )
    if not lags:
        return prefix

    # The last rows of every block, in order: before the first of them lie the
    # last rows of the blocks before it.
    depth = max(lags.values())
    newest = Window.partitionBy(keys.entity, BLOCK).orderBy(*[F.desc(c) for c in keys.order()])
    tail = hot.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= depth)
    timeline = f"PARTITION BY `{keys.entity}` ORDER BY {_names(keys.order())}"
    wanted = [(c, k) for c, n in lags.items() for k in range(1, n + 1)]
    tail = tail.selectExpr(
        _names([keys.entity]),
        BLOCK,
        f"{position} AS _position",
        *[f"lag(`{c}`, {k}) OVER ({timeline}) AS _tail{lag_name(c, k)}" for c, k in wanted],
    )
    names = [f"_tail{lag_name(c, k)}" for c, k in wanted]
    first = tail.groupBy(keys.entity, BLOCK).agg(F.min_by(F.struct(*names), "_position").alias("_t"))
    first = first.select(keys.entity, BLOCK, "_t.*")
    return prefix.join(first, [keys.entity, BLOCK])


def _combine_lag(col: str, k: int) -> str:
    """Inside the block when it reaches back far enough, else from the earlier rows."""
    outside = [f"WHEN {p} THEN _tail{lag_name(col, k - p + 1)}" for p in range(1, k + 1)]
    return f"CASE _pos {' '.join(outside)} ELSE _in{lag_name(col, k)} END"


def _combine_running(r: Running) -> str:
    local, before = f"`_local_{r.name}`", f"`_before_{r.name}`"
    if r.kind == "max":
        return f"greatest({before}, {local})"
    if r.kind == "first":
        return f"CASE WHEN _has_prefix THEN {before} ELSE {local} END"
    total = f"coalesce({before} + {local}, {before}, {local})"
    return f"coalesce({total}, 0)" if r.kind == "count" else total
