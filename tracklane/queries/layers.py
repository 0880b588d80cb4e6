"""The layers the queries read, built once per application and star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.operators.history import PanelKeys, split_hot, with_history
from tracklane.plans.base import base_table, rating_features
from tracklane.plans.raw import raw_results
from tracklane.runtime import store
from tracklane.sources.star_schema import orders_panel, results

ORDERS = PanelKeys("entity", "date", "tie")
_STORED: dict[tuple[str, str, str], str] = {}
# Layers that join stored tables: a reader joins the columns it wants, no wide copy is written.
JOINED = ("rated", "meet-rated")
_JOINS: dict[tuple[str, str, str], DataFrame] = {}


def _layer(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if name in JOINED:
        if key not in _JOINS:
            _JOINS[key] = build()
        return _JOINS[key]
    if key not in _STORED:
        _STORED[key] = store(build(), name).inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.parquet(_STORED[key])


def landing_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, "landing", lambda: results(spark, sf_dir))


def raw_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, "raw", lambda: raw_results(landing_layer(spark, sf_dir)))


def base_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir, "base", lambda: base_table(raw_layer(spark, sf_dir)))


def rated_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base layer with the rating, in rounds of a quarter."""
    return _layer(spark, sf_dir, "rated", lambda: rating_features(base_layer(spark, sf_dir), "quarter"))


def meet_rated_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base layer with the rating updated meet by meet, as the job does by default."""
    return _layer(spark, sf_dir, "meet-rated", lambda: rating_features(base_layer(spark, sf_dir)))


def orders_history(spark: SparkSession, sf_dir: str, lags=None, running=(), event_no=None) -> DataFrame:
    return with_history(split_hot(orders_panel(spark, sf_dir), ORDERS), ORDERS, lags, running, event_no)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column half up, as ``sql.half_up`` does on the SQL side."""
    scale = float(10**digits)
    return df.select(
        *[
            (F.floor(F.col(f.name) * scale + 0.5) / scale).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema
        ]
    )
