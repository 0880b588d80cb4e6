"""Landing to raw: typed results, each with an entity key and an origin country."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracklane.config import SETTINGS, Settings
from tracklane.operators.clean import cast_types, lower_case, numeric_place
from tracklane.operators.identity import add_birth_year, add_entity_key, one_row_per_rare, origin

REPEAT_KEYS = ["primary_key", "date", "meet_name"]
# Which of several rows of one key, date and meet is kept.
REPEAT_ORDER = ["place", "total_kg", "best3_squat_kg", "best3_bench_kg", "bodyweight_kg"]


def typed_results(landing: DataFrame) -> DataFrame:
    return landing.transform(numeric_place).transform(cast_types).transform(lower_case)


def identified_results(landing: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return typed_results(landing).transform(add_birth_year, settings=settings).transform(add_entity_key)


def raw_results(landing: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Repeated rows dropped, origin country attached.

    The origin is taken from the rows before they are deduplicated: ordered the
    same way, the earliest row is the one that would be kept, and it costs one
    narrow aggregate instead of a second deduplication.
    """
    rows = identified_results(landing, settings)
    earliest = origin(rows, "primary_key", "meet_country", ["date", "meet_name", *REPEAT_ORDER], "origin_country")
    return one_row_per_rare(rows, REPEAT_KEYS, REPEAT_ORDER).join(earliest, "primary_key", "left")
