"""Operators of a training-data pipeline: one module per operator, each with its query and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "packing decontaminate license_scan url_filter quality exact_dedup near_dedup secret_scan substring_dedup toxicity "
    "private_data whitening runs"
).split()


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in import_module(f"{__name__}.{module}").QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in import_module(f"{__name__}.{module}").SQL.items()}
