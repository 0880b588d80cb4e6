"""Descriptive and analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.config import SETTINGS
from tracklane.functions import columns as C
from tracklane.operators import analyses as A
from tracklane.operators import describe as D
from tracklane.operators import features as P
from tracklane.operators.identity import keep_active
from tracklane.operators.history import split_hot, with_history
from tracklane.operators.positions import group_quantiles, quartiles
from tracklane.queries import sql
from tracklane.queries.layers import ORDERS, base_layer, rounded
from tracklane.queries.sql import KNOWN, nearest, r
from tracklane.sources.star_schema import orders_panel

SEG = "sex, ipf_weight_class"


def orders_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly change of order totals by experience: active customers, gaps, rates, guard, buckets, quartiles."""
    active = keep_active(orders_panel(spark, sf_dir), ORDERS.entity)
    rows = with_history(split_hot(active, ORDERS), ORDERS, {"date": 1, "total": 1}, (), "event_no")
    rated = rows.select(
        C.experience_level("event_no").alias("experience_level"), P.guarded_progress("total", "date").alias("progress")
    ).filter(F.col("progress").isNotNull())
    spread = quartiles("progress_p25", "progress_median", "progress_p75", "linear")
    out = group_quantiles(rated, ["experience_level"], {"progress": spread}, {"sample_size": "progress"})
    return rounded(out.orderBy("experience_level"), 4)


def _base(fn, digits: int = 6):
    return lambda spark, sf_dir: rounded(fn(base_layer(spark, sf_dir)), digits)


QUERIES = {
    "orders_progress": orders_progress,
    "progress_by_segment": _base(D.progress_by_segment),
    "progress_by_segment_linear": _base(lambda df: D.progress_by_segment(df, "linear")),
    "progress_by_experience": _base(D.progress_by_experience),
    "progress_by_segment_experience": _base(D.progress_by_segment_and_experience),
    "quality_report": _base(D.quality_report),
    "null_rates": _base(D.null_rates),
    "score_norms": _base(D.score_norms),
    "tier_transitions": _base(D.tier_transitions),
    "career_trajectory": _base(A.career_trajectory),
    "indexed_growth": _base(A.indexed_growth, 8),
    "percentile_movement": _base(A.percentile_movement),
    "rolling_summary": _base(A.rolling_summary),
    "part_ratios": _base(A.part_ratios),
    "score_trajectory": _base(A.score_trajectory),
    "milestones": _base(A.milestone_attainment),
    "milestones_cumulative": _base(lambda df: A.milestone_attainment(df, mode="cumulative")),
    "career_summary": _base(A.career_summary),
    "archetypes": _base(lambda df: A.archetypes(df)[0]),
    "archetype_centroids": _base(lambda df: A.archetypes(df)[1]),
}


def _quartiles(col: str, out: str = "", method: str = "nearest", names: tuple[str, str, str] | None = None) -> str:
    low, mid, high = names or (f"{out or col}_p25", f"{out or col}_median", f"{out or col}_p75")
    at = nearest if method == "nearest" else (lambda c, q: f"quantile_cont({c}, {q})")
    return f"{r(at(col, 0.25), low)}, {r(f'median({col})', mid)}, {r(at(col, 0.75), high)}"


def _progress(groups: str, where: str = "TRUE", method: str = "nearest") -> str:
    cols = ", ".join(_quartiles(c, method=method) for c in D.PROGRESS)
    return sql.query(
        f"SELECT {groups}, {cols}, count(squat_progress) AS sample_size FROM x "
        f"WHERE total_progress IS NOT NULL AND {where} GROUP BY {groups}",
        "f3",
        x=f"SELECT *, {sql.experience('cumulative_comps')} AS experience_level FROM f3",
    )


def _by_event(cols: str, where: str, upto: str, count: str) -> str:
    return sql.query(
        f"SELECT {SEG}, cumulative_comps, {cols}, count({count}) AS sample_size FROM {upto} "
        f"WHERE {KNOWN} AND cumulative_comps <= 20 AND {where} GROUP BY {SEG}, cumulative_comps",
        upto,
    )


def _tenure_case(values) -> str:
    steps = " ".join(f"WHEN tenure <= {b} THEN {v}" for b, v in zip(SETTINGS.tenure_breaks, values))
    return f"CASE {steps} ELSE {list(values)[-1]} END"


def _milestones(mode: str) -> str:
    levels = " UNION ALL ".join(
        f"SELECT '{sex}' AS sex, unnest([{', '.join(map(str, kg))}]) AS milestone_kg" for sex, kg in SETTINGS.milestones.items()
    )
    early = f"SELECT * FROM f1 WHERE {KNOWN} AND cumulative_comps <= 20"
    best = """SELECT *, max(total) OVER (PARTITION BY primary_key ORDER BY date, meet_name
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM early"""
    group = "sex, ipf_weight_class, milestone_kg"
    if mode == "running_max":
        counts = f"""SELECT {group}, cumulative_comps, count(DISTINCT primary_key) AS n FROM best JOIN levels USING (sex)
  WHERE best >= milestone_kg AND total IS NOT NULL GROUP BY {group}, cumulative_comps"""
        agg = "max"
    else:
        counts = f"""SELECT {group}, cumulative_comps, count(*) AS n FROM (SELECT {group}, primary_key,
  min(cumulative_comps) AS cumulative_comps FROM best JOIN levels USING (sex) WHERE best >= milestone_kg
  GROUP BY {group}, primary_key) GROUP BY {group}, cumulative_comps"""
        agg = "sum"
    return sql.query(
        f"""SELECT c.sex, c.ipf_weight_class, CAST(milestone_kg AS INTEGER) AS milestone_kg, cumulative_comps,
  round({agg}(n) OVER (PARTITION BY c.sex, c.ipf_weight_class, milestone_kg ORDER BY cumulative_comps) / total_lifters, 6)
  AS fraction_reached, total_lifters
FROM counts c JOIN totals t ON c.sex = t.sex AND c.ipf_weight_class = t.ipf_weight_class""",
        "f1",
        early=early,
        best=best,
        levels=levels,
        counts=counts,
        totals=f"SELECT {SEG}, count(DISTINCT primary_key) AS total_lifters FROM early GROUP BY {SEG}",
    )


def _null_rates(report: bool) -> str:
    from tracklane.queries.features import ALL_FEATURES
    from tracklane.sources.schemas import BASE_INPUT, BASE_NAMES

    columns = [*[BASE_NAMES.get(c, c) for c in BASE_INPUT], *ALL_FEATURES]
    rates = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM base"
        for c in dict.fromkeys(columns)
    )
    listed = 'SELECT "column", round(rate, 4) AS null_rate FROM rates WHERE rate > 0.01'
    if not report:
        return sql.query(listed, rates=rates)
    return sql.query(
        """SELECT 'total_records' AS metric, CAST(count(*) AS VARCHAR) AS value FROM base
UNION ALL SELECT 'unique_lifters', CAST(count(DISTINCT primary_key) AS VARCHAR) FROM base
UNION ALL SELECT 'date_range_start', CAST(min(date) AS VARCHAR) FROM base
UNION ALL SELECT 'date_range_end', CAST(max(date) AS VARCHAR) FROM base
UNION ALL SELECT 'mean_comps_per_lifter', CAST(round(count(*) / count(DISTINCT primary_key), 2) AS VARCHAR) FROM base
UNION ALL SELECT 'columns_with_gt_1pct_nulls', '{' || string_agg('"' || "column" || '":' || CAST(null_rate AS VARCHAR), ','
  ORDER BY "column") || '}' FROM listed""",
        rates=rates,
        listed=listed,
    )


_TO = ", ".join(f"count(*) FILTER (WHERE max_tier = {t}) AS to_{t}" for t in range(5))

def _archetype_parts() -> dict[str, str]:
    """Careers, standardised points, seeds and steps of all restarts, and the best restart, as ``A.archetypes`` finds them."""
    n, k, dims = SETTINGS.cluster_restarts, SETTINGS.clusters, range(len(A.CAREER))
    apart = lambda a, b: " + ".join(f"({a}.f{i} - {b}.f{i}) * ({a}.f{i} - {b}.f{i})" for i in dims)
    fs = lambda a: ", ".join(f"{a}.f{i}" for i in dims)
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS f{i}" for i, c in enumerate(A.CAREER))
    parts = {
        "careers": f"""SELECT * FROM (SELECT primary_key, min(sex) AS sex, max(cumulative_comps) AS total_comps, max(tenure) AS career_tenure,
  max(total) AS max_total, max(wilks) AS max_wilks, median(total_progress) AS median_progress FROM f3 WHERE {KNOWN} GROUP BY primary_key)
WHERE sex IS NOT NULL AND total_comps IS NOT NULL AND career_tenure IS NOT NULL AND max_total IS NOT NULL AND max_wilks IS NOT NULL
  AND median_progress IS NOT NULL""",
        "z": f"SELECT primary_key, {scaled} FROM careers",
        "restarts": f"SELECT unnest(range({n})) AS restart",
    }
    for j in range(k):
        drawn = f"(CAST('0x' || substr(md5(z.primary_key || ':' || restart || ':{j}:{SETTINGS.cluster_seed}'), 1, 13) AS BIGINT) + 0.5) / pow(2, 52)"
        away = f"(SELECT min({apart('z', 's')}) FROM seeds{j - 1} s WHERE s.restart = restarts.restart)" if j else "1.0"
        parts[f"seeds{j}"] = (f"SELECT * FROM seeds{j - 1} UNION ALL " if j else "") + (
            f"SELECT restart, {j} AS cluster, {fs('p')} FROM (SELECT restart, z.*, row_number() OVER (PARTITION BY restart "
            f"ORDER BY {away} / -ln({drawn}) DESC, primary_key) AS place FROM restarts, z) p WHERE place = 1"
        )
    near = f"""SELECT restart, cluster, primary_key, d, {fs('x')} FROM (SELECT c.restart, c.cluster, z.*, {apart('z', 'c')} AS d,
  row_number() OVER (PARTITION BY c.restart, primary_key ORDER BY {apart('z', 'c')}, c.cluster) AS place FROM z, {{centres}} c) x WHERE place = 1"""
    means = ", ".join(f"avg(f{i}) AS f{i}" for i in dims)
    parts["moves"] = f"""SELECT CAST(0 AS BIGINT) AS step, restart, CAST(cluster AS BIGINT) AS cluster, {fs(f'seeds{k - 1}')} FROM seeds{k - 1}
UNION ALL SELECT o.step + 1, o.restart, o.cluster, {', '.join(f'coalesce(n.f{i}, o.f{i})' for i in dims)} FROM moves o
LEFT JOIN (SELECT restart, cluster, {means} FROM ({near.format(centres='moves')}) GROUP BY restart, cluster) n
  ON o.restart = n.restart AND o.cluster = n.cluster WHERE o.step < {SETTINGS.cluster_steps}"""
    parts["final"] = f"SELECT * FROM moves WHERE step = {SETTINGS.cluster_steps}"
    parts["placed"] = near.format(centres="final")
    parts["best"] = "SELECT restart FROM (SELECT restart, sum(d) AS cost FROM placed GROUP BY restart) ORDER BY round(cost, 6), restart LIMIT 1"
    parts["numbered"] = """SELECT cluster, CAST(row_number() OVER (ORDER BY min(primary_key)) - 1 AS INTEGER) AS number
FROM placed WHERE restart = (SELECT restart FROM best) GROUP BY cluster"""
    return parts


_BACK = ", ".join(
    f"round(f{i} * (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM careers) + (SELECT avg({c}) FROM careers), 6) AS {c}"
    for i, c in enumerate(A.CAREER)
)

SQL = {
    "archetypes": sql.query(
        """SELECT c.primary_key, c.sex, c.total_comps, c.career_tenure, round(c.max_total, 6) AS max_total, round(c.max_wilks, 6) AS max_wilks,
  round(c.median_progress, 6) AS median_progress, number AS cluster
FROM careers c JOIN placed USING (primary_key) JOIN numbered USING (cluster) WHERE restart = (SELECT restart FROM best)""",
        "f3",
        recursive=True,
        **_archetype_parts(),
    ),
    "archetype_centroids": sql.query(
        f"SELECT number AS cluster, {_BACK} FROM final JOIN numbered USING (cluster) WHERE restart = (SELECT restart FROM best)",
        "f3",
        recursive=True,
        **_archetype_parts(),
    ),
    "orders_progress": f"""WITH p AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date, o_orderkey AS tie,
  o_totalprice AS total FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 3),
l AS (SELECT *, row_number() OVER w AS event_no, lag(total) OVER w AS t1, date_diff('day', lag(date) OVER w, date) AS gap
  FROM p WINDOW w AS (PARTITION BY entity ORDER BY date, tie)),
g AS (SELECT {sql.experience('event_no')} AS experience_level,
  CASE WHEN gap >= 30 THEN (total - t1) / (gap / 365.25) END AS progress FROM l)
SELECT experience_level, round(quantile_cont(progress, 0.25), 4) AS progress_p25, round(median(progress), 4) AS progress_median,
  round(quantile_cont(progress, 0.75), 4) AS progress_p75, count(progress) AS sample_size
FROM g WHERE progress IS NOT NULL GROUP BY experience_level ORDER BY experience_level""",
    "progress_by_segment": _progress(SEG, KNOWN),
    "progress_by_segment_linear": _progress(SEG, KNOWN, "linear"),
    "progress_by_experience": _progress("experience_level"),
    "progress_by_segment_experience": _progress(f"{SEG}, experience_level", KNOWN),
    "quality_report": _null_rates(report=True),
    "null_rates": _null_rates(report=False),
    "score_norms": sql.query(
        f"""SELECT {SEG}, round(avg(dots), 6) AS mean_score, round(stddev_samp(dots), 6) AS std_score,
  count(dots) AS sample_size FROM f0 GROUP BY {SEG}""",
        "f0",
    ),
    "tier_transitions": sql.query(
        f"""SELECT CAST(starting_tier AS INTEGER) AS starting_tier, count(*) AS entities, {_TO},
  ['Beginner', 'Intermediate', 'Advanced', 'Elite', 'World Class'][starting_tier + 1] AS tier, count(*) < 50 AS too_few
FROM t WHERE starting_tier IS NOT NULL GROUP BY starting_tier""",
        "f1",
        t=f"""SELECT primary_key, max({sql.tier('first_dots')}) AS starting_tier, max({sql.tier('dots')}) AS max_tier
  FROM f1 GROUP BY primary_key""",
    ),
    "career_trajectory": sql.query(
        f"""SELECT {SEG}, {_tenure_case([f"'{x}'" for x in SETTINGS.tenure_labels])} AS tenure_bucket,
  CAST({_tenure_case(range(8))} AS INTEGER) AS tenure_order,
  {_quartiles('total', names=('total_p25', 'median_total', 'total_p75'))}, count(total) AS sample_size
FROM f2 WHERE {KNOWN} AND tenure IS NOT NULL GROUP BY {SEG}, tenure_bucket, tenure_order""",
        "f2",
    ),
    "indexed_growth": _by_event(
        ", ".join(r(f"median({m})", f"median_{m}", 8) for m in sql.MEASURES), "TRUE", "f1", "total"
    ),
    "percentile_movement": _by_event(
        _quartiles(
            "total_percentile_rank", names=("percentile_rank_p25", "median_percentile_rank", "percentile_rank_p75")
        ),
        "total_percentile_rank IS NOT NULL",
        "base",
        "total_percentile_rank",
    ),
    "rolling_summary": _by_event(
        ", ".join(r(f"median(rolling_avg_{m}_3)", f"median_rolling_{m}") for m in sql.MEASURES),
        "rolling_avg_total_3 IS NOT NULL",
        "f1",
        "rolling_avg_total_3",
    ),
    "part_ratios": sql.query(
        f"""SELECT {SEG}, experience_level, {', '.join(r(f'median({p}_ratio)', f'median_{p}_ratio') for p in sql.PARTS)},
  count(squat_ratio) AS sample_size
FROM (SELECT *, {sql.experience('cumulative_comps')} AS experience_level FROM f1 WHERE {KNOWN} AND squat_ratio IS NOT NULL)
GROUP BY {SEG}, experience_level""",
        "f1",
    ),
    "score_trajectory": _by_event(
        _quartiles("wilks", names=("wilks_p25", "median_wilks", "wilks_p75")), "wilks IS NOT NULL", "f1", "wilks"
    ),
    "milestones": _milestones("running_max"),
    "milestones_cumulative": _milestones("cumulative"),
    "career_summary": sql.query(
        f"""SELECT * FROM (SELECT primary_key, min(sex) AS sex, max(cumulative_comps) AS total_comps,
  max(tenure) AS career_tenure, round(max(total), 6) AS max_total, round(max(wilks), 6) AS max_wilks,
  round(median(total_progress), 6) AS median_progress FROM f3 WHERE {KNOWN} GROUP BY primary_key)
WHERE career_tenure IS NOT NULL AND max_wilks IS NOT NULL AND median_progress IS NOT NULL""",
        "f3",
    ),
}
