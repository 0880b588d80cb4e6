"""Column lists and types of the layers."""

from __future__ import annotations

from pyspark.sql import types as T

# The landing columns every later layer relies on, in order.
LANDING_TYPES: dict[str, T.DataType] = {
    "date": T.StringType(),
    "name": T.StringType(),
    "sex": T.StringType(),
    "place": T.StringType(),
    "age": T.DoubleType(),
    "age_class": T.StringType(),
    "bodyweight_kg": T.DoubleType(),
    "event": T.StringType(),
    "meet_country": T.StringType(),
    "equipment": T.StringType(),
    "best3_squat_kg": T.DoubleType(),
    "best3_bench_kg": T.DoubleType(),
    "best3_deadlift_kg": T.DoubleType(),
    "total_kg": T.DoubleType(),
    "wilks": T.DoubleType(),
    "tested": T.StringType(),
    "federation": T.StringType(),
    "meet_name": T.StringType(),
    "country": T.StringType(),
    "state": T.StringType(),
    "parent_federation": T.StringType(),
    "weight_class_kg": T.StringType(),
}

LANDING = T.StructType([T.StructField(n, t) for n, t in LANDING_TYPES.items()])

# Columns the raw layer adds that the base layer keeps.
RAW_ADDED = ["origin_country", "primary_key", "birth_year"]

# Names used from the base layer on.
BASE_NAMES = {
    "best3_squat_kg": "squat",
    "best3_bench_kg": "bench",
    "best3_deadlift_kg": "deadlift",
    "total_kg": "total",
    "bodyweight_kg": "bodyweight",
}

BASE_INPUT = [*LANDING_TYPES, *RAW_ADDED]

# Types of the reference tables, by file stem.
REFERENCE = {"meet-type": T.StructType([T.StructField("meet_type", T.StringType()), T.StructField("meet_type_id", T.IntegerType())])}
