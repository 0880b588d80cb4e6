"""Per-entity windows on the narrow panels: orders per customer, events per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions import columns as C
from tracklane.operators import features as P
from tracklane.operators.history import split_hot, with_history
from tracklane.operators.positions import add_percentile_rank, add_percentile_rank_asof
from tracklane.operators.segments import add_segment_mean
from tracklane.queries.layers import ORDERS, orders_history, rounded
from tracklane.sources.star_schema import events_panel, segmented_panel

KEY = ["entity", "tie"]


def lagged_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"total": 2})
    return rounded(
        rows.select(
            *KEY,
            P.at("total", 1).alias("previous_total"),
            P.change("total").alias("total_change"),
            P.change("total", 1).alias("prev_total_change"),
        )
    )


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"date": 1})
    days = P.gap_days("date")
    return rounded(
        rows.select(*KEY, days.alias("gap_days"), P.gap_years("date").alias("gap_years"), C.gap_category(days).alias("category"))
    )


def events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operators on the second panel."""
    rows = with_history(split_hot(events_panel(spark, sf_dir), ORDERS), ORDERS, {"date": 1, "total": 2}, (), "event_no")
    return rounded(
        rows.select(
            *KEY,
            "event_no",
            P.gap_days("date").alias("gap_days"),
            P.at("total", 1).alias("previous_value"),
            P.rolling_mean("total").alias("rolling_avg_value_3"),
        )
    )


def progress_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"date": 1, "total": 1})
    return rounded(
        rows.select(
            *KEY,
            P.progress("total", "date").alias("total_progress"),
            C.pct_change("total", P.at("total", 1)).alias("pct_change_total"),
        ),
        4,
    )


def tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, running=[P.first_of("first_date", "date")], event_no="event_no")
    days = P.tenure_days("date", "first_date", "event_no")
    return rows.select(*KEY, "event_no", days.alias("tenure"))


def experience_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, running=[P.first_of("first_date", "date")], event_no="event_no")
    years = P.tenure_days("date", "first_date", "event_no") / 365.25
    return rounded(
        rows.select(
            *KEY,
            F.log(F.col("event_no").cast("double")).alias("log_event_no"),
            years.alias("years"),
            F.when(years > 0, C.ratio("event_no", years)).alias("events_per_year"),
        )
    )


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"total": 3})
    return rounded(
        rows.select(
            *KEY, P.rolling_mean("total").alias("rolling_avg_3"), P.rolling_mean("total", k=1).alias("prev_rolling_avg_3")
        ),
        4,
    )


def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"total": 3})
    return rounded(rows.select(*KEY, P.rolling_std("total", k=1).alias("prev_rolling_std_3")), 4)


def personal_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"total": 1}, [P.running_max_prior("_best", "total")])
    best, previous = P.masked("_best", P.at("total", 1)), P.at("total", 1)
    return rounded(
        rows.select(*KEY, best.alias("best"), C.ratio(previous, best).alias("vs_best"), (best - previous).alias("distance"))
    )


def prev_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders_history(spark, sf_dir, {"date": 4, "total": 4})
    past = [P.guarded_progress("total", "date", k) for k in (3, 2, 1)]
    return rounded(
        rows.select(
            *KEY,
            past[-1].alias("prev_progress"),
            C.mean_of(past, 2).alias("prev_avg_progress_3"),
            P.guarded_pct_change("total", "date", 1).alias("prev_pct_change"),
        ),
        4,
    )


def segment_mean(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Decimal sums are exact in any order.
        panel = segmented_panel(spark, sf_dir).withColumn("total", F.col("total").cast("decimal(15,2)"))
        rows = add_segment_mean(panel, ["region", "market"], "date", "total", "segment_mean", mode, "tie")
        return rounded(rows.select(*KEY, "segment_mean", C.ratio("total", "segment_mean").alias("vs_segment_mean")), 4)

    return run


def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in steps of 2500, so that values repeat."""
    rows = segmented_panel(spark, sf_dir).withColumn("total", F.floor(F.col("total") / 2500) * 2500.0)
    ranked = add_percentile_rank(rows, ["region", "market"], "total", "percentile_rank")
    return rounded(ranked.select(*KEY, "total", "percentile_rank"))


def percentile_rank_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals among those of the segment up to the row's date."""
    rows = segmented_panel(spark, sf_dir).withColumn("total", F.floor(F.col("total") / 2500) * 2500.0)
    ranked = add_percentile_rank_asof(rows, ["region", "market"], "date", "total", "percentile_rank")
    return rounded(ranked.select(*KEY, "total", "percentile_rank"))


QUERIES = {
    "lagged_measures": lagged_measures,
    "event_gaps": event_gaps,
    "events_gaps": events_gaps,
    "progress_rates": progress_rates,
    "tenure": tenure,
    "experience_rates": experience_rates,
    "rolling_mean": rolling_mean,
    "rolling_std": rolling_std,
    "personal_best": personal_best,
    "prev_progress": prev_progress,
    "segment_mean": segment_mean("date"),
    "segment_mean_rows": segment_mean("row"),
    "percentile_rank": percentile_rank,
    "percentile_rank_asof": percentile_rank_asof,
}

_P = """p AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, o_orderkey AS tie, o_totalprice AS total FROM orders)"""
_L = f"""WITH {_P}, l AS (SELECT *, lag(date) OVER w AS d1, lag(total) OVER w AS t1, lag(total, 2) OVER w AS t2,
  row_number() OVER w AS event_no, first(date) OVER w AS first_date,
  CAST(date_diff('day', lag(date) OVER w, date) AS INTEGER) AS gap_days
  FROM p WINDOW w AS (PARTITION BY entity ORDER BY date, tie))"""
_SEG = """p AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, o_orderkey AS tie, o_totalprice AS total,
  n_regionkey AS region, c_mktsegment AS market FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""
_MEAN = """SELECT entity, tie, round(m, 4) AS segment_mean, round(total / nullif(m, 0), 4) AS vs_segment_mean FROM s"""
_W3 = "PARTITION BY entity ORDER BY date, tie ROWS BETWEEN"

SQL = {
    "lagged_measures": f"""{_L} SELECT entity, tie, round(t1, 6) AS previous_total, round(total - t1, 6) AS total_change,
  round(t1 - t2, 6) AS prev_total_change FROM l""",
    "event_gaps": f"""{_L} SELECT entity, tie, gap_days, round(gap_days / 365.25, 6) AS gap_years,
  CAST(CASE WHEN gap_days <= 90 THEN 1 WHEN gap_days <= 365 THEN 2 ELSE 3 END AS INTEGER) AS category FROM l""",
    "events_gaps": """SELECT user_id AS entity, event_id AS tie, row_number() OVER w AS event_no,
  CAST(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS INTEGER) AS gap_days,
  round(lag(value) OVER w, 6) AS previous_value,
  round(CASE WHEN count(value) OVER r = 3 THEN avg(value) OVER r END, 6) AS rolling_avg_value_3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
  r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "progress_rates": f"""{_L} SELECT entity, tie, round((total - t1) / nullif(gap_days / 365.25, 0), 4) AS total_progress,
  round(CASE WHEN t1 > 0 THEN (total - t1) / t1 * 100 END, 4) AS pct_change_total FROM l""",
    "tenure": f"""{_L} SELECT entity, tie, event_no, CAST(sum(gap_days) OVER (PARTITION BY entity ORDER BY date, tie
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS tenure FROM l""",
    "experience_rates": f"""{_L} SELECT entity, tie, round(ln(event_no), 6) AS log_event_no,
  round(CASE WHEN event_no > 1 THEN date_diff('day', first_date, date) / 365.25 END, 6) AS years,
  round(CASE WHEN date > first_date THEN event_no / (date_diff('day', first_date, date) / 365.25) END, 6) AS events_per_year
FROM l""",
    "rolling_mean": f"""WITH {_P}, m AS (SELECT *, CASE WHEN count(total) OVER r = 3 THEN avg(total) OVER r END AS m FROM p
  WINDOW r AS ({_W3} 2 PRECEDING AND CURRENT ROW))
SELECT entity, tie, round(m, 4) AS rolling_avg_3,
  round(lag(m) OVER (PARTITION BY entity ORDER BY date, tie), 4) AS prev_rolling_avg_3 FROM m""",
    "rolling_std": f"""WITH {_P} SELECT entity, tie,
  round(CASE WHEN count(total) OVER r >= 2 THEN stddev_samp(total) OVER r END, 4) AS prev_rolling_std_3
FROM p WINDOW r AS ({_W3} 3 PRECEDING AND 1 PRECEDING)""",
    "personal_best": f"""{_L}, b AS (SELECT *, CASE WHEN t1 IS NOT NULL THEN max(t1) OVER ({_W3} UNBOUNDED PRECEDING
  AND CURRENT ROW) END AS best FROM l)
SELECT entity, tie, round(best, 6) AS best, round(t1 / nullif(best, 0), 6) AS vs_best, round(best - t1, 6) AS distance FROM b""",
    "prev_progress": f"""{_L}, g AS (SELECT *, CASE WHEN gap_days < 30 THEN NULL
    ELSE (total - t1) / nullif(gap_days / 365.25, 0) END AS rate,
  CASE WHEN gap_days < 30 THEN NULL WHEN t1 > 0 THEN (total - t1) / t1 * 100 END AS pct FROM l)
SELECT entity, tie, round(lag(rate) OVER w, 4) AS prev_progress,
  round(CASE WHEN count(rate) OVER r >= 2 THEN avg(rate) OVER r END, 4) AS prev_avg_progress_3,
  round(lag(pct) OVER w, 4) AS prev_pct_change
FROM g WINDOW w AS (PARTITION BY entity ORDER BY date, tie), r AS ({_W3} 3 PRECEDING AND 1 PRECEDING)""",
    "segment_mean": f"""WITH {_SEG}, s AS (SELECT *, CAST(sum(CAST(total AS DECIMAL(15,2))) OVER d AS DOUBLE) / count(*) OVER d AS m
  FROM p WINDOW d AS (PARTITION BY region, market ORDER BY date
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)) {_MEAN}""",
    "segment_mean_rows": f"""WITH {_SEG}, s AS (SELECT *, CAST(sum(CAST(total AS DECIMAL(15,2))) OVER d AS DOUBLE) / count(*) OVER d AS m
  FROM p WINDOW d AS (PARTITION BY region, market ORDER BY date, tie
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) {_MEAN}""",
    "percentile_rank": f"""WITH {_SEG}, f AS (SELECT entity, tie, region, market, floor(total / 2500) * 2500.0 AS total FROM p)
SELECT entity, tie, CAST(total AS DOUBLE) AS total, round((rank() OVER (PARTITION BY region, market ORDER BY total)
  + (count(*) OVER (PARTITION BY region, market, total) - 1) / 2.0) / count(*) OVER (PARTITION BY region, market) * 100, 6)
  AS percentile_rank FROM f""",
    "percentile_rank_asof": f"""WITH {_SEG}, f AS (SELECT entity, tie, date, region, market, floor(total / 2500) * 2500.0 AS total FROM p)
SELECT a.entity, a.tie, CAST(any_value(a.total) AS DOUBLE) AS total, round((count(*) FILTER (b.total < a.total)
  + (count(*) FILTER (b.total = a.total) + 1) / 2.0) / count(*) * 100, 6) AS percentile_rank
FROM f a JOIN f b ON a.region = b.region AND a.market = b.market AND b.date <= a.date GROUP BY a.entity, a.tie""",
}
