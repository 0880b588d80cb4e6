"""Who a row belongs to: derived keys, repeated rows, namesakes, origin, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.functions.columns import entity_key, half_year_age
from tracklane.runtime import store


def add_birth_year(df: DataFrame, date: str = "date", age: str = "age", settings: Settings = SETTINGS) -> DataFrame:
    """Event year, half-year age, the birth-year window and its floored middle."""
    tolerance = settings.age_tolerance_years
    year, half_age = F.year(date), half_year_age(age)
    low, high = year - (half_age + tolerance), year - (half_age - tolerance)
    return df.withColumns(
        {
            "event_year": year,
            "age_rounded_up_half": half_age,
            "min_birth_year": low,
            "max_birth_year": high,
            "birth_year": F.floor((low + high) / 2).cast("int"),
        }
    )


def add_entity_key(df: DataFrame, out: str = "primary_key") -> DataFrame:
    return df.withColumn(out, entity_key("name", "sex", "birth_year"))


def one_row_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows sharing ``keys`` (null equals null), the first by ``order``, nulls first.

    The limit on the row number is applied before the exchange as well, so a key
    with any number of copies sends one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") == 1).drop("_rank")


REPEATED_KEYS = 500_000  # hashes of keys, 8 bytes each, that tell rows apart before any exchange


def one_row_per_rare(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``one_row_per`` for rows of which few share their keys; ``df`` is read three times, so it should be a cheap scan.

    A row whose hashed keys no other row has is alone and stays where it is. Only the others are exchanged and sorted.
    With more than ``REPEATED_KEYS`` shared hashes all rows go that way.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    repeated = hashed.groupBy("_hash").count().filter("count > 1").select("_hash")
    repeated = store(repeated, "repeated-keys")
    if repeated.count() > REPEATED_KEYS:
        return one_row_per(df, keys, order)
    several = one_row_per(hashed.join(repeated, "_hash", "left_semi").drop("_hash"), keys, order)
    return hashed.join(repeated, "_hash", "left_anti").drop("_hash").unionByName(several)


def origin(df: DataFrame, entity: str, value: str, order: Sequence[str], out: str) -> DataFrame:
    """One row per entity: ``value`` of its earliest row."""
    return df.groupBy(entity).agg(F.min_by(value, F.struct(*order)).alias(out))


def add_origin(df: DataFrame, entity: str, value: str, order: Sequence[str], out: str) -> DataFrame:
    """Left-join each entity's earliest ``value``; the right side is unique, so no row is added."""
    return df.join(origin(df, entity, value, order, out), entity, "left")


def entity_sizes(df: DataFrame, entity: str, name: str, birth_year: str) -> DataFrame:
    """One row per key: lower-case name, birth year and row count."""
    return df.groupBy(entity).agg(
        F.min(F.lower(name)).alias("name_lower"),
        F.min(birth_year).alias("birth_year"),
        F.count(F.lit(1)).alias("record_count"),
    )


def namesakes_to_drop(sizes: DataFrame, entity: str, years: int = 3) -> DataFrame:
    """Keys with fewer rows than a key of the same name born within ``years``; ties keep both.

    The window runs over one row per name and birth year, so a name shared by
    any number of keys stays a few rows long.
    """
    by_year = sizes.groupBy("name_lower", "birth_year").agg(F.max("record_count").alias("largest"))
    near = Window.partitionBy("name_lower").orderBy("birth_year").rangeBetween(-years, years)
    nearby = by_year.withColumn("largest", F.max("largest").over(near))
    return (
        sizes.join(nearby, ["name_lower", "birth_year"])
        .filter(F.col("record_count") < F.col("largest"))
        .select(entity)
    )


def drop_namesakes(
    df: DataFrame, entity: str = "primary_key", name: str = "name", birth_year: str = "birth_year"
) -> DataFrame:
    """Anti-join the drop list. Rows without a key pass; ``keep_active`` removes them."""
    drop = namesakes_to_drop(entity_sizes(df, entity, name, birth_year), entity)
    return df.join(drop, entity, "left_anti")


def keep_active(df: DataFrame, entity: str = "primary_key", settings: Settings = SETTINGS) -> DataFrame:
    """Keep entities with enough rows; rows without a key count as none."""
    active = df.groupBy(entity).agg(F.count(entity).alias("n")).filter(F.col("n") >= settings.min_events)
    return df.join(active.select(entity), entity, "left_semi")


def resolve_entities(
    df: DataFrame,
    entity: str = "primary_key",
    name: str = "name",
    birth_year: str = "birth_year",
    settings: Settings = SETTINGS,
) -> DataFrame:
    """``drop_namesakes`` then ``keep_active`` from one count per key and one semi-join."""
    sizes = entity_sizes(df.filter(F.col(entity).isNotNull()), entity, name, birth_year)
    active = sizes.filter(F.col("record_count") >= settings.min_events)
    kept = active.join(namesakes_to_drop(sizes, entity), entity, "left_anti")
    return df.join(kept.select(entity), entity, "left_semi")


def join_invariant(left: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Rows before and after a lookup join, and lookup keys that would multiply rows."""

    def metric(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")

    repeated = lookup.groupBy(on).count().filter(F.col("count") > 1)
    return (
        metric(left, "rows_before")
        .unionByName(metric(left.join(lookup, on, "left"), "rows_after"))
        .unionByName(metric(repeated, "repeated_keys"))
    )
