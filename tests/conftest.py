from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import DataFrame, SparkSession

PANEL_SCHEMA = (
    "primary_key string, name string, date date, sex string, bodyweight double, squat double, bench double, "
    "deadlift double, total double, dots double, wilks double, birth_year int"
)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tracklane-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def panel_rows() -> list[tuple]:
    """Three entities, five yearly events each."""
    entities = {
        "L1": ("M", 80.0, (300, 320, 340, 360, 380), (0.35, 0.25, 0.40), lambda i: 200.0 + 15 * i, 1995),
        "L2": ("M", 90.0, (500, 505, 500, 510, 508), (0.35, 0.25, 0.40), lambda i: 290.0 + i, 1990),
        "L3": ("F", 75.0, (650, 680, 710, 740, 770), (0.33, 0.27, 0.40), lambda i: 420.0 + 12 * i, 1993),
    }
    rows = []
    for key, (sex, bw, totals, shares, score, born) in entities.items():
        for i, total in enumerate(totals):
            lifts = [total * s for s in shares]
            rows.append((key, key, date(2020 + i, 6, 1), sex, bw, *lifts, float(total), score(i), score(i), born))
    return rows


@pytest.fixture
def panel(spark) -> DataFrame:
    rows = panel_rows()
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, PANEL_SCHEMA)


def random_panel(seed: int, entities: int = 6, longest: int = 25) -> list[tuple]:
    """(entity, date, tie, total): uneven lengths, same-day events, nulls, short gaps."""
    draw, rows, tie = random.Random(seed), [], 0
    for e in range(entities):
        day = date(2020, 1, 1)
        for _ in range(draw.randint(1, longest)):
            day += timedelta(days=draw.choice([0, 0, 1, 7, 29, 30, 90, 91, 365, 366]))
            tie += 1
            total = None if draw.random() < 0.2 else float(draw.randint(0, 40) * 25)
            rows.append((f"e{e}", day, tie, total))
    draw.shuffle(rows)
    return rows
