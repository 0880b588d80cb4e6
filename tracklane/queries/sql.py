"""Shared parts of the SQL twins, written for DuckDB on the same tables."""

from __future__ import annotations

from tracklane.config import SETTINGS

_AGE_CLASSES = " ".join(
    "WHEN floor(age) BETWEEN {} AND {} THEN '{}'".format(*label.split("-"), label) for label in SETTINGS.age_class_midpoint
)


def weight_class_case(sex: str, bw: str) -> str:
    branches = []
    for letter, bounds in SETTINGS.weight_classes.items():
        finite = [b for b in bounds if b != float("inf")]
        steps = " ".join(f"WHEN {bw} <= {b} THEN '{b}'" for b in finite)
        branches.append(f"WHEN upper(substr({sex}, 1, 1)) = '{letter}' THEN CASE {steps} ELSE '{finite[-1]}+' END")
    return f"CASE WHEN {bw} IS NULL THEN 'unknown' {' '.join(branches)} ELSE 'unknown' END"


def dots_case(sex: str, bw: str, total: str) -> str:
    branches = []
    for code, k in SETTINGS.dots_coefficients.items():
        k = [f"CAST({c!r} AS DOUBLE)" for c in k]
        poly = f"(((({k[0]}*{bw}+{k[1]})*{bw}+{k[2]})*{bw}+{k[3]})*{bw}+{k[4]})"
        branches.append(f"WHEN {sex} = '{code}' THEN {total} * 500.0 / nullif({poly}, 0)")
    return f"CASE {' '.join(branches)} END"


def tier(score: str) -> str:
    steps = " + ".join(f"CAST({score} >= {b} AS INTEGER)" for b in SETTINGS.tier_bounds)
    return f"CASE WHEN {score} IS NULL THEN NULL ELSE {steps} END"


def experience(col: str) -> str:
    labels = SETTINGS.experience_labels
    steps = " ".join(f"WHEN {col} <= {b} THEN '{x}'" for b, x in zip(SETTINGS.experience_breaks, labels))
    return f"CASE {steps} ELSE '{labels[-1]}' END"


def nearest(col: str, q: float) -> str:
    """Row ``round((n - 1) q)`` of the sorted non-null values."""
    return (
        f"(list({col} ORDER BY {col}) FILTER (WHERE {col} IS NOT NULL))"
        f"[CAST(floor((count({col}) - 1) * {q} + 0.5) AS BIGINT) + 1]"
    )


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name or expr}"


def half_up(text: str) -> str:
    """Spell out ``round(x, d)`` as ``floor(x * 10^d + 0.5) / 10^d``.

    The engines' own functions treat a value that lies on a decimal tie
    differently; this form is the same arithmetic on both sides.
    """
    while (start := text.find("round(")) >= 0:
        depth, end, comma = 1, start + len("round("), -1
        while depth:
            ch = text[end]
            depth += (ch == "(") - (ch == ")")
            comma = end if ch == "," and depth == 1 else comma
            end += 1
        inner, scale = text[start + len("round(") : comma], 10 ** int(text[comma + 1 : end - 1])
        text = f"{text[:start]}(floor(({inner}) * CAST({scale} AS DOUBLE) + 0.5) / CAST({scale} AS DOUBLE)){text[end:]}"
    return text


PARTS = ("squat", "bench", "deadlift")
MEASURES = ("total", *PARTS)

CTES: dict[str, str] = {}

CTES["li"] = """
SELECT l_orderkey, count(*) AS n_lines,
  CAST(sum(CAST(floor(0.5 + l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS qty,
  CAST(sum(CAST(floor(0.5 + l_discount * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS disc,
  CAST(sum(CAST(floor(0.5 + l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS ext,
  CAST(sum(CAST(floor(0.5 + l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / 100.0 AS ext_r,
  CAST(sum(CAST(floor(0.5 + l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) / 100.0 AS ext_a,
  CAST(sum(CAST(floor(0.5 + l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) / 100.0 AS ext_n
FROM lineitem GROUP BY l_orderkey"""

CTES["aged"] = """
SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, floor(o_totalprice / 250.0) / 2.0 AS kg,
  CASE WHEN o_orderkey % 97 <> 0 THEN CAST(year(o_orderdate) - (1940 + c_custkey % 40) AS DOUBLE)
    + 0.5 * CAST(c_custkey % 2 AS DOUBLE) - CASE WHEN o_orderkey % 23 = 0 THEN 1.0 ELSE 0.0 END END AS age
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN li ON o_orderkey = l_orderkey"""

CTES["results"] = f"""
SELECT day AS date, c_mktsegment || ' ' || c_name || ' ' || n_name AS name,
  CASE WHEN n_regionkey IN (0, 1) THEN 'M' WHEN n_regionkey IN (2, 3) THEN 'F' ELSE 'Mx' END AS sex,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'DQ' ELSE substr(o_orderpriority, 1, 1) END AS place,
  CAST(age AS DOUBLE) AS age,
  CASE WHEN age IS NULL THEN NULL {_AGE_CLASSES} END AS age_class,
  CAST(35.0 + 2.0 * (qty / n_lines) AS DOUBLE) AS bodyweight_kg,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN 'B' ELSE 'SBD' END AS event,
  o_orderstatus AS meet_country,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'Wraps' ELSE 'Raw' END AS equipment,
  kg * ext_r / nullif(ext, 0) AS best3_squat_kg,
  kg * ext_a / nullif(ext, 0) AS best3_bench_kg,
  kg * ext_n / nullif(ext, 0) + 50.0 * (disc / n_lines) AS best3_deadlift_kg,
  kg AS total_kg, 3.0 * qty AS wilks,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN NULL ELSE 'Yes' END AS tested,
  c_mktsegment AS federation,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'World Cup' WHEN '2-HIGH' THEN 'National Open'
    WHEN '3-MEDIUM' THEN 'State Titles' WHEN '4-NOT SPECIFIED' THEN 'International Classic' END
    || ' ' || substr(day, 1, 7) AS meet_name,
  n_name AS country, 'S' || CAST(n_regionkey AS VARCHAR) AS state,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS parent_federation,
  CAST(n_lines AS VARCHAR) AS weight_class_kg
FROM aged"""

CTES["typed"] = r"""
SELECT * REPLACE (CAST(date AS DATE) AS date, CAST(place AS BIGINT) AS place, lower(meet_name) AS meet_name)
FROM (SELECT * FROM results WHERE regexp_matches(place, '^\d+$'))"""

CTES["born"] = """
SELECT *, CAST(year(date) AS INTEGER) AS event_year,
  CASE WHEN age % 1 = 0 THEN age + 0.5 ELSE age END AS age_rounded_up_half,
  year(date) - (CASE WHEN age % 1 = 0 THEN age + 0.5 ELSE age END + 2) AS min_birth_year,
  year(date) - (CASE WHEN age % 1 = 0 THEN age + 0.5 ELSE age END - 2) AS max_birth_year,
  CAST(floor(year(date) - CASE WHEN age % 1 = 0 THEN age + 0.5 ELSE age END) AS INTEGER) AS birth_year
FROM typed"""

CTES["keyed"] = """
SELECT *, regexp_replace(lower(name), ' ', '-') || '-' || lower(sex) || '-' || CAST(birth_year AS VARCHAR) AS primary_key
FROM born"""

CTES["identified"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY primary_key, date, meet_name
  ORDER BY place NULLS FIRST, total_kg NULLS FIRST, best3_squat_kg NULLS FIRST, best3_bench_kg NULLS FIRST,
  bodyweight_kg NULLS FIRST) AS rn FROM keyed) WHERE rn = 1"""

CTES["raw"] = """
SELECT i.*, o.origin_country FROM identified i LEFT JOIN (SELECT primary_key, meet_country AS origin_country FROM
  (SELECT *, row_number() OVER (PARTITION BY primary_key ORDER BY date, meet_name NULLS FIRST) AS rn FROM identified)
  WHERE rn = 1) o ON i.primary_key = o.primary_key"""

CTES["projected"] = """
SELECT date, name, sex, place, age, age_class, bodyweight_kg AS bodyweight, event, meet_country, equipment,
  best3_squat_kg AS squat, best3_bench_kg AS bench, best3_deadlift_kg AS deadlift, total_kg AS total, wilks, tested,
  federation, coalesce(meet_name, 'local') AS meet_name, country, state,
  coalesce(parent_federation, 'Independent') AS parent_federation, weight_class_kg, origin_country, primary_key, birth_year
FROM raw"""

CTES["raw_events"] = "SELECT * FROM projected WHERE event = 'SBD' AND tested = 'Yes' AND equipment = 'Raw'"

CTES["sizes"] = """
SELECT primary_key, min(lower(name)) AS name_lower, min(birth_year) AS birth_year, count(*) AS n
FROM raw_events WHERE primary_key IS NOT NULL GROUP BY primary_key"""

CTES["eligible"] = """
SELECT * FROM raw_events WHERE primary_key IN (SELECT primary_key FROM sizes WHERE n >= 3)
  AND primary_key NOT IN (SELECT a.primary_key FROM sizes a JOIN sizes b ON a.name_lower = b.name_lower
    WHERE a.primary_key <> b.primary_key AND abs(a.birth_year - b.birth_year) <= 3 AND a.n < b.n)"""

CTES["f0"] = f"""
SELECT *, {weight_class_case('sex', 'bodyweight')} AS ipf_weight_class,
  CASE WHEN meet_name LIKE '%national%' THEN 2
    WHEN regexp_matches(meet_name, 'international|world|commonwealth') THEN 1
    WHEN meet_name LIKE '%state%' THEN 3 ELSE 4 END AS meet_type,
  meet_country = origin_country AS is_origin_country,
  CAST(year(date) - birth_year AS INTEGER) AS approx_age,
  CAST(year(date) - birth_year - 29 AS INTEGER) AS years_from_peak_age,
  CAST(abs(year(date) - birth_year - 29) AS INTEGER) AS abs_years_from_peak_age,
  total / nullif(bodyweight, 0) AS total_per_bw,
  {dots_case('sex', 'bodyweight', 'total')} AS dots,
  {', '.join(f'{p} / nullif(total, 0) AS {p}_ratio' for p in PARTS)}
FROM eligible"""

_LAGGED = [*MEASURES, "wilks", "dots", "bodyweight", "date"]
CTES["f1"] = f"""
SELECT *, row_number() OVER w AS cumulative_comps,
  {', '.join(f'lag({c}) OVER w AS previous_{c}' for c in _LAGGED)},
  lag(total, 2) OVER w AS previous2_total,
  {', '.join(f'CASE WHEN count({c}) OVER r3 = 3 THEN avg({c}) OVER r3 END AS rolling_avg_{c}_3' for c in [*MEASURES, 'dots'])},
  CASE WHEN count(total) OVER p3 >= 2 THEN stddev_samp(total) OVER p3 END AS prev_rolling_std_total_3,
  max(total) OVER prior AS best_total, max(dots) OVER prior AS best_dots,
  {', '.join(f'first({c}) OVER w AS first_{c}' for c in ('date', 'total', 'bodyweight', 'dots', 'approx_age', 'sex', 'ipf_weight_class'))},
  {', '.join(f'count(CASE WHEN dots >= {b} THEN 1 END) OVER prior AS comps_above_{n}_so_far'
             for n, b in zip(('intermediate', 'advanced', 'elite', 'world_class'), SETTINGS.tier_bounds))}
FROM f0
WINDOW w AS (PARTITION BY primary_key ORDER BY date, meet_name),
  r3 AS (PARTITION BY primary_key ORDER BY date, meet_name ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  p3 AS (PARTITION BY primary_key ORDER BY date, meet_name ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  prior AS (PARTITION BY primary_key ORDER BY date, meet_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

CTES["f2"] = """
SELECT *, CAST(date_diff('day', previous_date, date) AS INTEGER) AS time_since_last_comp_days,
  date_diff('day', previous_date, date) / 365.25 AS time_since_last_comp_years,
  CASE WHEN cumulative_comps > 1 THEN CAST(date_diff('day', first_date, date) AS INTEGER) END AS tenure
FROM f1"""


def _rate(m: str) -> str:
    raw = f"({m} - previous_{m}) / nullif(time_since_last_comp_years, 0)"
    return f"CASE WHEN time_since_last_comp_days < 30 THEN NULL ELSE {raw} END AS {m}_progress"


def _pct(m: str) -> str:
    return (
        f"CASE WHEN time_since_last_comp_days < 30 THEN NULL WHEN previous_{m} > 0 "
        f"THEN ({m} - previous_{m}) / previous_{m} * 100 END AS pct_change_{m}"
    )


CTES["f3"] = f"""
SELECT *, {', '.join(_rate(m) for m in [*MEASURES, 'wilks', 'dots'])}, {_pct('total')}, {_pct('dots')},
  CASE WHEN time_since_last_comp_days <= 90 THEN 1 WHEN time_since_last_comp_days <= 365 THEN 2 ELSE 3 END AS time_gap_category,
  tenure / 365.25 AS years_competing, ln(cumulative_comps) AS log_cumulative_comps,
  CASE WHEN tenure > 0 THEN cumulative_comps / (tenure / 365.25) END AS comps_per_year,
  bodyweight - previous_bodyweight AS bodyweight_change,
  {', '.join(f'previous_{p} / nullif(previous_total, 0) AS prev_{p}_ratio' for p in PARTS)},
  previous_total / nullif(bodyweight, 0) AS prev_total_per_bw,
  previous_total - previous2_total AS prev_total_change_kg,
  {', '.join(f'lag(rolling_avg_{m}_3) OVER w AS prev_rolling_avg_{m}_3' for m in [*MEASURES, 'dots'])},
  CASE WHEN previous_total IS NOT NULL THEN best_total END AS prev_personal_best_total,
  CASE WHEN previous_dots IS NOT NULL THEN best_dots END AS prev_dots_personal_best,
  date_diff('day', first_date, date) AS since_first
FROM f2 WINDOW w AS (PARTITION BY primary_key ORDER BY date, meet_name)"""

CTES["f4"] = f"""
SELECT *, previous_total / nullif(prev_personal_best_total, 0) AS prev_total_vs_pb,
  prev_personal_best_total - previous_total AS prev_distance_from_pb,
  previous_dots / nullif(prev_dots_personal_best, 0) AS prev_dots_vs_pb,
  prev_dots_personal_best - previous_dots AS prev_distance_from_pb_dots,
  lag(total_progress) OVER w AS prev_total_progress,
  CASE WHEN count(total_progress) OVER p3 >= 2 THEN avg(total_progress) OVER p3 END AS prev_avg_progress_3,
  lag(pct_change_total) OVER w AS prev_pct_change, lag(pct_change_dots) OVER w AS prev_pct_change_dots,
  previous_total * time_since_last_comp_years AS prev_total_x_time_gap,
  previous_total / nullif(cumulative_comps, 0) AS prev_total_per_comp,
  first_dots AS first_comp_dots, first_total / nullif(first_bodyweight, 0) AS first_comp_total_per_bw,
  first_approx_age AS first_comp_age, prev_dots_personal_best AS max_dots_so_far,
  CASE WHEN lag(pct_change_dots) OVER w IS NOT NULL THEN max(pct_change_dots) OVER prior END AS best_growth_rate_so_far,
  max(CASE WHEN cumulative_comps = 3 THEN dots END) OVER e AS third_dots,
  max(CASE WHEN cumulative_comps = 3 THEN date END) OVER e AS third_date,
  CASE WHEN previous_dots IS NOT NULL AND count(previous_dots) OVER upto >= 2
      AND max(CASE WHEN previous_dots IS NOT NULL THEN since_first END) OVER upto
        > min(CASE WHEN previous_dots IS NOT NULL THEN since_first END) OVER upto
    THEN regr_slope(previous_dots, since_first) OVER upto END AS dots_growth_trend,
  {tier('first_dots')} AS starting_tier, {tier('previous_dots')} AS prev_tier,
  {tier('prev_dots_personal_best')} AS max_tier_so_far
FROM f3
WINDOW w AS (PARTITION BY primary_key ORDER BY date, meet_name), e AS (PARTITION BY primary_key),
  upto AS (PARTITION BY primary_key ORDER BY date, meet_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  p3 AS (PARTITION BY primary_key ORDER BY date, meet_name ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  prior AS (PARTITION BY primary_key ORDER BY date, meet_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def percentile_rank(x: str, groups: str = "sex, ipf_weight_class") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {groups} ORDER BY {x} NULLS LAST) "
        f"+ (count({x}) OVER (PARTITION BY {groups}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {groups}) * 100 END"
    )


CTES["firsts"] = f"""
SELECT primary_key, {percentile_rank('dots')} AS first_comp_percentile_vs_sex_wc
FROM f4 WHERE cumulative_comps = 1"""

CTES["base"] = f"""
SELECT f4.*, p.first_comp_percentile_vs_sex_wc, max_tier_so_far - starting_tier AS tiers_climbed_so_far,
  starting_tier * years_competing AS starting_tier_x_years_competing,
  max_tier_so_far * time_since_last_comp_years AS max_tier_x_time_gap,
  CASE WHEN cumulative_comps >= 4 AND third_date > first_date
    THEN (third_dots - first_dots) / (date_diff('day', first_date, third_date) / 365.25) END AS early_growth_rate_dots_per_year,
  segment_mean_total, total / nullif(segment_mean_total, 0) AS total_vs_segment_mean,
  previous_total / nullif(segment_mean_total, 0) AS prev_total_vs_segment_mean,
  {percentile_rank('total')} AS total_percentile_rank, {percentile_rank('previous_total')} AS prev_total_percentile_rank
FROM (SELECT *, avg(total) OVER (PARTITION BY sex, ipf_weight_class ORDER BY date
  RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS segment_mean_total FROM f4) f4
JOIN firsts p USING (primary_key)"""


def query(select: str, upto: str = "base", recursive: bool = False, **more: str) -> str:
    """``select`` over the shared parts up to ``upto`` and further named parts."""
    parts = []
    for name, body in CTES.items():
        parts.append(f"{name} AS ({body})")
        if name == upto:
            break
    parts += [f"{name} AS ({body})" for name, body in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def rating_parts(period: str, field: str, rows: str = "f0") -> dict[str, str]:
    """All rating rounds as one recursion: a step holds the rating of every entity after a period.

    ``rated`` has one row per event with the rating before it, its change and the field's mean.
    """
    expected = "1.0 / (1.0 + pow(10.0, (mean - rating) / 400.0))"
    return {
        "ev": f"""SELECT *, dense_rank() OVER (ORDER BY p) AS step,
  row_number() OVER (PARTITION BY p, {field} ORDER BY coalesce(total, 0), primary_key, date, meet_name) - 1 AS pos,
  count(*) OVER (PARTITION BY p, {field}) AS size,
  32 * CASE meet_type WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 ELSE 0.6 END AS k
  FROM (SELECT *, date_trunc('{period}', date) AS p FROM {rows})""",
        "people": f"SELECT DISTINCT primary_key FROM {rows}",
        "r": f"""SELECT CAST(0 AS BIGINT) AS step, primary_key, CAST(1500.0 AS DOUBLE) AS rating FROM people
UNION ALL
SELECT cur.step + 1, cur.primary_key, cur.rating + coalesce(d.change, 0) FROM r cur LEFT JOIN (
  SELECT primary_key, sum(change) AS change FROM (
    SELECT primary_key, {field}, arg_max(k * (pos / nullif(size - 1, 0) - {expected}), pos) AS change
    FROM (SELECT ev.*, rating, avg(rating) OVER (PARTITION BY {field}) AS mean
      FROM ev JOIN r ON ev.primary_key = r.primary_key AND ev.step = r.step + 1)
    WHERE size > 1 GROUP BY primary_key, {field}) GROUP BY primary_key) d ON cur.primary_key = d.primary_key
WHERE cur.step < (SELECT max(step) FROM ev)""",
        "rated": f"""SELECT primary_key, date, meet_name, rating AS elo_rating, mean AS meet_field_elo,
  CASE WHEN size > 1 THEN k * (pos / (size - 1) - {expected}) END AS elo_change
FROM (SELECT ev.*, rating, avg(rating) OVER (PARTITION BY p, {field}) AS mean
  FROM ev JOIN r ON ev.primary_key = r.primary_key AND ev.step = r.step + 1)""",
    }


def meet_rating_parts(contest: str, rows: str = "f0") -> dict[str, str]:
    """The rating contest by contest, as two recursions: levels of contests, then ratings level by level.

    ``contest`` lists its columns, the date first. A step holds the rating of every entity before the contests of a level.
    """
    expected = "1.0 / (1.0 + pow(10.0, (mean - rating) / 400.0))"
    return {
        "placed": f"""SELECT *, row_number() OVER (PARTITION BY {contest} ORDER BY coalesce(total, 0), primary_key, date, meet_name) - 1 AS pos,
  count(*) OVER (PARTITION BY {contest}) AS size, dense_rank() OVER (ORDER BY {contest}) AS number,
  32 * CASE meet_type WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 ELSE 0.6 END AS k FROM {rows}""",
        "ev": """SELECT *, CASE WHEN size > 1 THEN number END AS contest, max(CASE WHEN size > 1 THEN number END) OVER
  (PARTITION BY primary_key ORDER BY number RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM placed""",
        "edges": "SELECT DISTINCT previous, contest FROM ev WHERE contest IS NOT NULL AND previous IS NOT NULL",
        "waiting": """SELECT DISTINCT CAST(1 AS BIGINT) AS level, contest FROM edges
UNION SELECT w.level + 1, e.contest FROM waiting w JOIN edges e ON e.previous = w.contest""",
        "levels": """SELECT contest, coalesce(level, 0) AS level FROM (SELECT DISTINCT contest FROM ev WHERE contest IS NOT NULL)
  LEFT JOIN (SELECT contest, max(level) AS level FROM waiting GROUP BY contest) USING (contest)""",
        "stepped": """SELECT ev.*, coalesce(own.level, before.level + 1, 0) AS level
FROM ev LEFT JOIN levels own ON ev.contest = own.contest LEFT JOIN levels before ON ev.previous = before.contest""",
        "people": f"SELECT DISTINCT primary_key FROM {rows}",
        "r": f"""SELECT CAST(0 AS BIGINT) AS level, primary_key, CAST(1500.0 AS DOUBLE) AS rating FROM people
UNION ALL
SELECT cur.level + 1, cur.primary_key, cur.rating + coalesce(d.change, 0) FROM r cur LEFT JOIN (
  SELECT primary_key, arg_max(k * (pos / (size - 1) - {expected}), pos) AS change
  FROM (SELECT s.*, rating, avg(rating) OVER (PARTITION BY number) AS mean
    FROM stepped s JOIN r ON s.primary_key = r.primary_key AND s.level = r.level WHERE contest IS NOT NULL)
  GROUP BY primary_key) d ON cur.primary_key = d.primary_key
WHERE cur.level <= (SELECT max(level) FROM levels)""",
        "rated": f"""SELECT primary_key, date, meet_name, rating AS elo_rating, mean AS meet_field_elo,
  CASE WHEN size > 1 THEN k * (pos / (size - 1) - {expected}) END AS elo_change
FROM (SELECT s.*, rating, avg(rating) OVER (PARTITION BY number) AS mean
  FROM stepped s JOIN r ON s.primary_key = r.primary_key AND s.level = r.level)""",
    }


KNOWN = "sex IN ('M', 'F') AND ipf_weight_class <> 'unknown'"
