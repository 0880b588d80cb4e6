"""Derived columns: every function takes and returns ``Column``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``; null when the denominator is 0 or either side is null."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def pct_change(current: Column | str, previous: Column | str) -> Column:
    """Change in percent; null unless the previous value is positive."""
    cur, prev = as_col(current), as_col(previous)
    return F.when(prev > 0, ratio(cur - prev, prev) * 100)


def step_label(value: Column | str, upper_bounds: Sequence, labels: Sequence, default=None) -> Column:
    """Label of the first upper bound (inclusive) that holds ``value``; else ``default``."""
    value = as_col(value)
    branches = list(zip(upper_bounds, labels))
    chain = F.when(value <= branches[0][0], F.lit(branches[0][1]))
    for bound, label in branches[1:]:
        chain = chain.when(value <= bound, F.lit(label))
    return chain.otherwise(F.lit(default))


# --- identity -------------------------------------------------------------------


def hyphenate_first_space(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), "^([^ ]*) ", "$1-")


def entity_key(name: Column | str, sex: Column | str, birth_year: Column | str) -> Column:
    """``lower(name)`` with its first space hyphenated, sex and birth year; null if any part is null."""
    return F.concat(
        hyphenate_first_space(F.lower(as_col(name))),
        F.lit("-"),
        F.lower(as_col(sex)),
        F.lit("-"),
        as_col(birth_year).cast("string"),
    )


def half_year_age(age: Column | str) -> Column:
    """Whole ages stand for a birthday somewhere in the year: add half a year."""
    age = as_col(age)
    return F.when(age % 1 == 0, age + 0.5).otherwise(age)


# --- categories -----------------------------------------------------------------


def meet_type(meet_name: Column | str) -> Column:
    """2 national, 1 international, 3 state, 4 local; the order of the tests matters."""
    name = as_col(meet_name)
    return (
        F.when(name.contains("national"), 2)
        .when(name.rlike("international|world|commonwealth"), 1)
        .when(name.contains("state"), 3)
        .otherwise(4)
    )


def weight_class(sex: Column | str, bodyweight: Column | str, settings: Settings = SETTINGS) -> Column:
    """Class label by upper bound (inclusive), open class ``<last>+``, else 'unknown'."""
    letter, bw = F.upper(F.substring(as_col(sex), 1, 1)), as_col(bodyweight)
    chain = F.when(bw.isNull(), F.lit("unknown"))
    for code, bounds in settings.weight_classes.items():
        finite = [b for b in bounds if b != float("inf")]
        label = step_label(bw, finite, [str(b) for b in finite], f"{finite[-1]}+")
        chain = chain.when(letter == code, label)
    return chain.otherwise("unknown")


def experience_level(event_no: Column | str, settings: Settings = SETTINGS) -> Column:
    labels = settings.experience_labels
    return step_label(event_no, settings.experience_breaks, labels, labels[-1])


def experience_order(event_no: Column | str, settings: Settings = SETTINGS) -> Column:
    n = len(settings.experience_breaks)
    return step_label(event_no, settings.experience_breaks, range(n), n)


def tenure_bucket(tenure: Column | str, settings: Settings = SETTINGS) -> Column:
    labels = settings.tenure_labels
    return step_label(tenure, settings.tenure_breaks, labels, labels[-1])


def tenure_order(tenure: Column | str, settings: Settings = SETTINGS) -> Column:
    n = len(settings.tenure_breaks)
    return step_label(tenure, settings.tenure_breaks, range(n), n)


def gap_category(gap_days: Column | str, settings: Settings = SETTINGS) -> Column:
    """1 short, 2 medium, 3 long; an unknown gap counts as long."""
    return step_label(gap_days, (settings.gap_short_days, settings.gap_medium_days), (1, 2), 3)


def tier(score: Column | str, settings: Settings = SETTINGS) -> Column:
    """Ordinal of the half-open score tier; null score, null tier."""
    score = as_col(score)
    return reduce(lambda a, b: a + b, [(score >= bound).cast("int") for bound in settings.tier_bounds])


def tier_name(ordinal: Column | str, settings: Settings = SETTINGS) -> Column:
    # try_element_at is 1-based and yields null for a null ordinal.
    return F.try_element_at(F.array(*map(F.lit, settings.tier_names)), as_col(ordinal) + 1)


# --- scores ---------------------------------------------------------------------


def dots(sex: Column | str, bodyweight: Column | str, total: Column | str, settings: Settings = SETTINGS) -> Column:
    """``500 * total / quartic(bodyweight)``; null for a sex without coefficients."""
    sex, bw, total = as_col(sex), as_col(bodyweight), as_col(total)
    chain = None
    for code, coefficients in settings.dots_coefficients.items():
        denominator = reduce(lambda acc, k: acc * bw + F.lit(k), coefficients[1:], F.lit(coefficients[0]))
        score = ratio(total * 500.0, denominator)
        chain = F.when(sex == code, score) if chain is None else chain.when(sex == code, score)
    return chain


# --- encodings ------------------------------------------------------------------


def strict_lookup(value: Column | str, mapping: Mapping, what: str) -> Column:
    """Value of ``mapping``; null stays null, an unmapped value is an error."""
    value = as_col(value)
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(pairs, value)
    miss = F.raise_error(F.concat(F.lit(f"unmapped {what}: "), value.cast("string")))
    return F.when(value.isNull(), F.lit(None)).when(hit.isNull(), miss).otherwise(hit)


def weight_class_number(label: Column | str) -> Column:
    text = F.regexp_replace(as_col(label), r"\+", "")
    return F.regexp_replace(text, "unknown", "0").cast("double")


# --- combining a few neighbouring values ----------------------------------------


def count_present(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])


def _sum_present(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])


def mean_of(values: Sequence[Column], min_present: int) -> Column:
    """Mean of the non-null values when at least ``min_present`` of them exist."""
    n = count_present(values)
    return F.when(n >= min_present, F.try_divide(_sum_present(values), n.cast("double")))


def std_of(values: Sequence[Column], min_present: int) -> Column:
    """Sample standard deviation of the non-null values, at least two of them."""
    n, mean = count_present(values), mean_of(values, 1)
    squares = _sum_present([(v - mean) * (v - mean) for v in values])
    return F.when(n >= max(min_present, 2), F.sqrt(F.try_divide(squares, (n - 1).cast("double"))))
