"""Per-entity features, as expressions over the lags of ``with_history``.

``k`` counts events back from the current row: 0 is the row itself, 1 the event
before it. A feature of the event before is the same expression with ``k=1``, so
lagged features need no second window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.functions.columns import mean_of, pct_change, ratio, std_of
from tracklane.operators.clean import short_gap_guard
from tracklane.operators.history import PanelKeys, Running, lag_name


def at(col: str, k: int = 0) -> Column:
    return F.col(col) if k == 0 else F.col(lag_name(col, k))


def gap_days(date: str, k: int = 0) -> Column:
    return F.datediff(at(date, k), at(date, k + 1))


def gap_years(date: str, k: int = 0, settings: Settings = SETTINGS) -> Column:
    return gap_days(date, k) / settings.days_in_year


def change(measure: str, k: int = 0) -> Column:
    return at(measure, k) - at(measure, k + 1)


def progress(measure: str, date: str, k: int = 0, settings: Settings = SETTINGS) -> Column:
    """Change per year since the event before; null on the first event or a gap of 0."""
    return ratio(change(measure, k), gap_years(date, k, settings))


def guarded_progress(measure: str, date: str, k: int = 0, settings: Settings = SETTINGS) -> Column:
    return short_gap_guard(progress(measure, date, k, settings), gap_days(date, k), settings)


def guarded_pct_change(measure: str, date: str, k: int = 0, settings: Settings = SETTINGS) -> Column:
    return short_gap_guard(pct_change(at(measure, k), at(measure, k + 1)), gap_days(date, k), settings)


def rolling_mean(measure: str, window: int = 3, k: int = 0) -> Column:
    """Mean of ``window`` events ending at ``k``; null unless all of them have a value."""
    return mean_of([at(measure, k + i) for i in reversed(range(window))], window)


def rolling_std(measure: str, window: int = 3, min_present: int = 2, k: int = 0) -> Column:
    return std_of([at(measure, k + i) for i in reversed(range(window))], min_present)


def masked(running: str, previous: Column) -> Column:
    """A running value is shown only where the value it would take in is present."""
    return F.when(previous.isNotNull(), F.col(running))


def tenure_days(date: str, first_date: str, event_no: str) -> Column:
    """Sum of all gaps so far, which is the distance to the first event; null on that event."""
    return F.when(F.col(event_no) > 1, F.datediff(date, first_date))


def running_max_prior(name: str, measure: str) -> Running:
    return Running(name, "max", F.col(measure), prior=True)


def count_prior_at_least(name: str, measure: str, bound: float) -> Running:
    """Earlier events at or above ``bound``; 0 on the first event."""
    return Running(name, "count", F.when(F.col(measure) >= bound, 1), prior=True)


def first_of(name: str, measure: str) -> Running:
    return Running(name, "first", F.col(measure))


# --- features that need the derived columns of a first pass ----------------------

TREND_SUMS = ("n", "x", "y", "xy", "xx")


def trend_running(prefix: str, x: Column, y: Column) -> list[Running]:
    """Sums from which ``trend_slope`` fits a line through all pairs so far."""
    both = x.isNotNull() & y.isNotNull()
    x, y = x.cast("double"), y.cast("double")
    terms = {"n": F.lit(1.0), "x": x, "y": y, "xy": x * y, "xx": x * x}
    return [Running(f"{prefix}_{name}", "sum", F.when(both, terms[name])) for name in TREND_SUMS]


def trend_slope(prefix: str) -> Column:
    """Least-squares slope; null below two points or without spread in x."""
    n, x, y, xy, xx = (F.col(f"{prefix}_{name}") for name in TREND_SUMS)
    spread = xx - x * x / n
    return F.when((n >= 2) & (spread > 0), (xy - x * y / n) / spread)


def value_at_event(name: str, event_no: str, number: int, value: str) -> Running:
    """Value of event ``number``, known from that event on."""
    return Running(name, "max", F.when(F.col(event_no) == number, F.col(value)))


def early_growth(
    event_no: str, first_date: str, first_value: str, third_date: str, third_value: str, settings: Settings = SETTINGS
) -> Column:
    """Growth per year from event 1 to event 3, shown from event 4 on."""
    years = F.datediff(third_date, first_date) / settings.days_in_year
    growth = ratio(F.col(third_value) - F.col(first_value), years)
    return F.when((F.col(event_no) >= 4) & (years > 0), growth)


def leakage_report(
    df: DataFrame,
    keys: PanelKeys,
    event_no: str,
    pairs: Mapping[str, str],
    counters: Mapping[str, tuple[str, float]] | None = None,
    constants: Sequence[str] = (),
    maxima: Mapping[str, str] | None = None,
    tolerance: float = 1e-9,
    derived: Mapping[str, Callable[[Callable[[str], Column]], Column]] | None = None,
    reads: Sequence[str] = (),
    asked: Sequence[str] = (),
) -> DataFrame:
    """Per feature, the rows that do not follow from the event before.

    ``pairs`` maps a lagged column to its source; ``counters`` a count of earlier
    events to ``(source, bound)``; ``constants`` must not change within an entity;
    ``maxima`` maps the largest value of earlier events to its source.
    ``derived`` gives any other column from the event before, whose columns ``reads`` names.
    A column of ``asked`` without a rule is a row with null mismatches.
    Event ``n`` is joined to event ``n - 1``, independently of any window.
    """
    counters, maxima = dict(counters or {}), dict(maxima or {})
    sources = sorted({*pairs.values(), *counters, *constants, *maxima, *maxima.values(), *(source for source, _ in counters.values()), *reads})
    before = df.select(
        F.col(keys.entity),
        (F.col(event_no) + 1).alias(event_no),
        F.lit(True).alias("_found"),
        *[F.col(c).cast("double").alias(f"_src_{c}") for c in sources],
    )
    both = df.join(before, [keys.entity, event_no], "left")

    def differs(column: str, expected: Column) -> Column:
        a = F.col(column).cast("double")
        return ~a.eqNullSafe(expected) & F.coalesce(F.abs(a - expected) > tolerance, F.lit(True))

    def src(column: str) -> Column:
        return F.col(f"_src_{column}")

    rules = {c: differs(c, src(s)) for c, s in pairs.items()}
    for c, (source, bound) in counters.items():
        step = F.coalesce((src(source) >= bound).cast("double"), F.lit(0.0))
        rules[c] = differs(c, F.when(F.col("_found"), src(c) + step).otherwise(0.0))
    rules.update({c: F.col("_found") & differs(c, src(c)) for c in constants})
    rules.update({c: differs(c, F.greatest(src(c), src(s))) for c, s in maxima.items()})

    rules.update({c: differs(c, rule(src).cast("double")) for c, rule in (derived or {}).items()})

    checks = [F.struct(F.lit(c).alias("feature"), F.col(f"_bad_{c}").alias("mismatches")) for c in rules]
    checks += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("long").alias("mismatches")) for c in asked if c not in rules]
    counted = both.agg(*[F.count_if(rule).alias(f"_bad_{c}") for c, rule in rules.items()])
    return counted.select(F.inline(F.array(*checks)))


def truncation_report(
    full: DataFrame,
    cut: DataFrame,
    own: DataFrame,
    keys: PanelKeys,
    event_no: str,
    columns: Sequence[str],
    tolerance: float = 1e-6,
) -> DataFrame:
    """Per feature, rows it changes on when what it must not know is taken away.

    ``full`` holds the rows up to a date, computed from whole histories, ``cut`` the same rows computed without any later row:
    a difference (``from_later``) is knowledge of the future, of the entity or of others. ``own`` was computed with other
    measures in each entity's last row; a difference in that row (``from_own``, not counted at an entity's first event)
    is knowledge of the event itself. Columns that ``own`` lacks have a null there.
    """
    key = [keys.entity, *keys.order()]
    shown = [c for c in columns if c in own.columns]
    ends = full.groupBy(keys.entity).agg(F.max(event_no).alias("_last"))
    rows = full.select(*key, event_no, *[F.col(c).cast("double").alias(f"_full_{c}") for c in columns])
    rows = rows.join(ends, keys.entity)  # first: later the rows are three times as wide
    rows = rows.join(cut.select(*key, *[F.col(c).cast("double").alias(f"_cut_{c}") for c in columns]), key, "left")
    rows = rows.join(own.select(*key, *[F.col(c).cast("double").alias(f"_own_{c}") for c in shown]), key, "left")

    def differs(c: str, other: str) -> Column:
        a, b = F.col(f"_full_{c}"), F.col(f"_{other}_{c}")
        return ~a.eqNullSafe(b) & F.coalesce(F.abs(a - b) > tolerance, F.lit(True))

    tested = (F.col(event_no) == F.col("_last")) & (F.col(event_no) > 1)
    counts = [F.count_if(differs(c, "cut")).alias(f"later_{c}") for c in columns]
    counts += [F.count_if(tested & differs(c, "own")).alias(f"own_{c}") for c in shown]
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"later_{c}").alias("from_later"),
            (F.col(f"own_{c}") if c in shown else F.lit(None).cast("long")).alias("from_own"),
        )
        for c in columns
    ]
    return rows.agg(*counts).select(F.inline(F.array(*entries)))
