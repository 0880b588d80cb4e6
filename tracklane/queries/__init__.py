"""Every operator as a named query, each with its SQL twin where one exists."""

from tracklane.queries import cleaning, features, modelling, panel, reports, sql, storage

_MODULES = (storage, cleaning, panel, features, reports, modelling)


def all_queries() -> dict:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql.half_up(text) for module in _MODULES for name, text in module.SQL.items()}
