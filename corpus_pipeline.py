"""The corpus pipeline: stages over ``documents``, each written and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklane.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from tracklane.llm.common import Scratch, table

STAGES = [
    ("quality", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None  # SQL expresses neither the classifier nor the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole ``documents`` table; returns the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return docs
