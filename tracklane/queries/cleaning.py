"""Filters, typing, repair, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions import columns as C
from tracklane.operators import clean, identity
from tracklane.operators.features import gap_days, guarded_progress, progress
from tracklane.operators.model import winsorize
from tracklane.plans.base import eligible_rows
from tracklane.plans.raw import typed_results
from tracklane.queries import sql
from tracklane.queries.layers import landing_layer, orders_history, raw_layer, rounded
from tracklane.sources.schemas import BASE_INPUT, BASE_NAMES
from tracklane.sources.star_schema import orders_panel, table


def numeric_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.numeric_place(landing_layer(spark, sf_dir)).select("name", "date", "place", "meet_name")


def type_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_results(landing_layer(spark, sf_dir)).select("name", "date", "place", "meet_name")


def meet_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.lower_case(landing_layer(spark, sf_dir)).fillna({"meet_name": "local"})
    return rows.withColumn("meet_type", C.meet_type("meet_name")).groupBy("meet_name", "meet_type").agg(
        F.count(F.lit(1)).alias("n")
    )


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = raw_layer(spark, sf_dir).select(*BASE_INPUT).withColumnsRenamed(BASE_NAMES)
    return clean.fill_defaults(renamed, {"parent_federation": "Independent", "meet_name": "local"})


def base_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_projected(spark, sf_dir))


def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_event(_projected(spark, sf_dir)).select("primary_key", "date", "meet_name", "equipment")


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir).groupBy("parent_federation", "meet_name").agg(F.count(F.lit(1)).alias("n"))


def rate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"date": 1, "total": 1})
    return rounded(
        rows.select(
            "entity",
            "tie",
            gap_days("date").alias("gap_days"),
            progress("total", "date").alias("rate"),
            guarded_progress("total", "date").alias("guarded_rate"),
        ),
        4,
    )


def winsorized(interpolation: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        clipped = winsorize(orders_panel(spark, sf_dir), "total", interpolation)
        return rounded(clipped.select("tie", "total"), 4)

    return run


def _quality(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _projected(spark, sf_dir)
        kept = clean.apply_rules(rows, {rule: clean.quality_rules()[rule]})
        return rounded(kept.select("name", "date", "meet_name", "sex", "bodyweight", "squat", "total"))

    return run


def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.drop_report(_projected(spark, sf_dir), clean.quality_rules()))


def birth_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.add_birth_year(typed_results(landing_layer(spark, sf_dir)))
    return rows.select("name", "date", "event_year", "age_rounded_up_half", "min_birth_year", "max_birth_year", "birth_year")


def entity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.add_entity_key(identity.add_birth_year(typed_results(landing_layer(spark, sf_dir))))
    return rows.select("name", "date", "primary_key")


def dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").select(*keys, *order)
    return identity.one_row_per(lines, keys, order).drop("l_shipdate")


def origin_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.add_origin(orders_panel(spark, sf_dir), "entity", "o_orderstatus", ["date", "tie"], "origin")
    return rows.select("entity", "tie", "origin", (F.col("origin") == F.col("o_orderstatus")).alias("is_origin"))


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raw_layer(spark, sf_dir))


def join_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = orders_panel(spark, sf_dir)
    return identity.join_invariant(panel, identity.origin(panel, "entity", "o_orderstatus", ["date", "tie"], "origin"), "entity")


def namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: names repeat, size stands for the birth year, line items for the rows."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("record_count"))
    sizes = (
        table(spark, sf_dir, "part")
        .join(counts, F.col("p_partkey") == F.col("l_partkey"))
        .select("p_partkey", F.lower("p_name").alias("name_lower"), F.col("p_size").alias("birth_year"), "record_count")
    )
    return identity.namesakes_to_drop(sizes, "p_partkey")


def drop_namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = identity.drop_namesakes(clean.keep_event(_projected(spark, sf_dir)))
    return kept.filter(F.col("primary_key").isNotNull()).select("primary_key", "date", "meet_name")


def min_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.keep_active(orders_panel(spark, sf_dir), "entity").select("entity", "tie")


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(eligible_rows(raw_layer(spark, sf_dir)))


QUERIES = {
    "numeric_place": numeric_place,
    "type_cast": type_cast,
    "meet_type": meet_type,
    "base_projection": base_projection,
    "event_filter": event_filter,
    "fill_defaults": fill_defaults,
    "rate_guard": rate_guard,
    "winsorize": winsorized("nearest"),
    "winsorize_linear": winsorized("linear"),
    "quality_bombout": _quality("bombout"),
    "quality_consistency": _quality("total_consistency"),
    "quality_bodyweight": _quality("bodyweight"),
    "quality_drop_report": drop_report,
    "birth_year": birth_year,
    "entity_key": entity_key,
    "dedupe_results": dedupe_results,
    "origin_country": origin_country,
    "raw_results": raw_results,
    "join_invariant": join_invariant,
    "namesakes": namesakes,
    "drop_namesakes": drop_namesakes,
    "min_events": min_events,
    "eligible_rows": eligible,
}

_DOUBLE = {"age", "bodyweight", "bodyweight_kg", "wilks", "squat", "bench", "deadlift", "total", "total_kg"}
_DOUBLE |= {"best3_squat_kg", "best3_bench_kg", "best3_deadlift_kg", "age_rounded_up_half", "min_birth_year", "max_birth_year"}
_BASE = ", ".join(sql.r(c) if c in _DOUBLE else c for c in (BASE_NAMES.get(c, c) for c in BASE_INPUT))
_RAW_COLUMNS = [*BASE_INPUT, "event_year", "age_rounded_up_half", "min_birth_year", "max_birth_year"]
_RAW = ", ".join(sql.r(c) if c in _DOUBLE else c for c in _RAW_COLUMNS)
_QUALITY = {
    "bombout": "squat > 0 AND bench > 0 AND deadlift > 0",
    "total_consistency": "abs(squat + bench + deadlift - total) <= 2.5",
    "bodyweight": "(sex = 'M' AND bodyweight BETWEEN 40 AND 210) OR (sex = 'F' AND bodyweight BETWEEN 40 AND 150)",
}


def _quality_sql(rule: str) -> str:
    cols = f"name, date, meet_name, sex, {sql.r('bodyweight')}, {sql.r('squat')}, {sql.r('total')}"
    return sql.query(f"SELECT {cols} FROM projected WHERE {_QUALITY[rule]}", "projected")


def _report_sql() -> str:
    flags = ", ".join(f"coalesce({rule}, FALSE) AS {name}" for name, rule in _QUALITY.items())
    passed, rows = "TRUE", []
    for i, name in enumerate(_QUALITY, 1):
        rows.append(
            f"SELECT CAST({i} AS INTEGER) AS step, '{name}' AS rule, count(*) FILTER (WHERE {passed}) AS rows_before, "
            f"count(*) FILTER (WHERE {passed} AND NOT {name}) AS rows_dropped, "
            f"round(count(*) FILTER (WHERE {passed} AND NOT {name}) * 100.0 / "
            f"nullif(count(*) FILTER (WHERE {passed}), 0), 6) AS pct_dropped FROM flags"
        )
        passed += f" AND {name}"
    return sql.query(" UNION ALL ".join(rows), "projected", flags=f"SELECT {flags} FROM projected")


def _winsor_sql(low: str, high: str) -> str:
    return f"""WITH b AS (SELECT {low} AS lo, {high} AS hi FROM orders)
SELECT o_orderkey AS tie, round(greatest(least(o_totalprice, hi), lo), 4) AS total FROM orders, b"""


_ORDERS = """p AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, o_orderkey AS tie, o_totalprice AS total FROM orders)"""

SQL = {
    "numeric_place": sql.query(r"SELECT name, date, place, meet_name FROM results WHERE regexp_matches(place, '^\d+$')", "results"),
    "type_cast": sql.query("SELECT name, date, place, meet_name FROM typed", "typed"),
    "meet_type": sql.query(
        """SELECT meet_name, CAST(CASE WHEN contains(meet_name, 'national') THEN 2
  WHEN contains(meet_name, 'international') OR contains(meet_name, 'world') OR contains(meet_name, 'commonwealth') THEN 1
  WHEN contains(meet_name, 'state') THEN 3 ELSE 4 END AS INTEGER) AS meet_type, count(*) AS n
FROM (SELECT coalesce(lower(meet_name), 'local') AS meet_name FROM results) GROUP BY 1, 2""",
        "results",
    ),
    "base_projection": sql.query(f"SELECT {_BASE} FROM projected", "projected"),
    "event_filter": sql.query("SELECT primary_key, date, meet_name, equipment FROM raw_events", "raw_events"),
    "fill_defaults": sql.query("SELECT parent_federation, meet_name, count(*) AS n FROM projected GROUP BY 1, 2", "projected"),
    "rate_guard": f"""WITH {_ORDERS}, l AS (SELECT *, lag(date) OVER w AS d1, lag(total) OVER w AS t1 FROM p
  WINDOW w AS (PARTITION BY entity ORDER BY date, tie)),
g AS (SELECT *, CAST(date_diff('day', d1, date) AS INTEGER) AS gap_days FROM l)
SELECT entity, tie, gap_days, round((total - t1) / nullif(gap_days / 365.25, 0), 4) AS rate,
  CASE WHEN gap_days < 30 THEN NULL ELSE round((total - t1) / nullif(gap_days / 365.25, 0), 4) END AS guarded_rate FROM g""",
    "winsorize": _winsor_sql(sql.nearest("o_totalprice", 0.01), sql.nearest("o_totalprice", 0.99)),
    "winsorize_linear": _winsor_sql("quantile_cont(o_totalprice, 0.01)", "quantile_cont(o_totalprice, 0.99)"),
    "quality_bombout": _quality_sql("bombout"),
    "quality_consistency": _quality_sql("total_consistency"),
    "quality_bodyweight": _quality_sql("bodyweight"),
    "quality_drop_report": _report_sql(),
    "birth_year": sql.query(
        "SELECT name, date, event_year, age_rounded_up_half, min_birth_year, max_birth_year, birth_year FROM born", "born"
    ),
    "entity_key": sql.query("SELECT name, date, primary_key FROM keyed", "keyed"),
    "dedupe_results": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""",
    "origin_country": """SELECT o_custkey AS entity, o_orderkey AS tie,
  first(o_orderstatus) OVER w AS origin, first(o_orderstatus) OVER w = o_orderstatus AS is_origin
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""",
    "raw_results": sql.query(f"SELECT {_RAW} FROM raw", "raw"),
    "join_invariant": """SELECT 'rows_before' AS metric, count(*) AS value FROM orders
UNION ALL SELECT 'rows_after', count(*) FROM orders UNION ALL SELECT 'repeated_keys', 0""",
    "namesakes": """WITH s AS (SELECT p_partkey, lower(p_name) AS name, p_size AS year, count(*) AS n
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)
SELECT DISTINCT a.p_partkey FROM s a JOIN s b ON a.name = b.name AND a.p_partkey <> b.p_partkey
  AND abs(a.year - b.year) <= 3 AND a.n < b.n""",
    "drop_namesakes": sql.query(
        """SELECT primary_key, date, meet_name FROM raw_events WHERE primary_key NOT IN (SELECT a.primary_key
  FROM sizes a JOIN sizes b ON a.name_lower = b.name_lower
  WHERE a.primary_key <> b.primary_key AND abs(a.birth_year - b.birth_year) <= 3 AND a.n < b.n)""",
        "sizes",
    ),
    "min_events": """SELECT o_custkey AS entity, o_orderkey AS tie FROM orders
QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 3""",
    "eligible_rows": sql.query(f"SELECT {_BASE} FROM eligible", "eligible"),
}
