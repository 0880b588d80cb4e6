"""Model rows, split, fits and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.operators import metrics as M
from tracklane.operators import model as ML
from tracklane.queries import sql
from tracklane.queries.layers import base_layer, meet_rated_layer, rated_layer, rounded

KEY = ["primary_key", "date", "meet_name"]
TARGET = "pct_change_total"
FRAME = ML.feature_set(8, post_event=True)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible rows with their split and two simple predictions to evaluate."""
    rows = ML.temporal_split(ML.eligible_for_model(base_layer(spark, sf_dir), TARGET))
    return ML.encode_categories(rows).withColumns(
        {"pred": F.col("prev_pct_change") * -0.5, "pred_dots": F.col("prev_pct_change_dots") * -0.5}
    )


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ML.model_frame(rated_layer(spark, sf_dir), TARGET, FRAME), 4)


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select(*KEY, "split")


def baseline_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.baseline_rmse(_split(spark, sf_dir), TARGET))


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.regression_metrics(_split(spark, sf_dir).filter("split = 'test'"), TARGET, "pred"))


def scale_free_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.scale_free_metrics(_split(spark, sf_dir).filter("split = 'test'"), TARGET, "pred"))


def segment_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.segment_metrics(_split(spark, sf_dir), TARGET, "pred", ML.segment_dims()))


def _two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir).filter("split = 'test'")
    first = rows.filter(F.col("pred").isNotNull()).select(*KEY, "pred", "starting_tier")
    second = rows.filter(F.col("pred_dots").isNotNull()).select(*KEY, "pred_dots", "starting_tier")
    return M.prediction_table(first, second, KEY, ["starting_tier"])


def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_two_tables(spark, sf_dir))


def prediction_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prediction_overlap(_two_tables(spark, sf_dir), "pred", "pred_dots")


CANDIDATES = [
    *["bodyweight", "cumulative_comps", "tenure", "previous_total", "previous_wilks", "prev_total_per_bw"],
    *["segment_mean_total", "prev_distance_from_pb", "prev_total_progress", "comps_per_year", "prev_pct_change"],
]


def _importance_ranks(rows: DataFrame, features: list[str], corr=F.corr, **top: int) -> DataFrame:
    """Features by absolute correlation with the target, of training rows and of test rows."""
    entries, scores = [], []
    for v in ("train", "test"):
        for f in features:
            inside = F.when(F.col("split") == v, F.col(f).cast("double"))
            scores.append(F.abs(corr(inside, F.col(TARGET))).alias(f"{v}_{f}"))
            entries.append(
                F.struct(F.lit(v).alias("version"), F.lit(f).alias("feature"), F.col(f"{v}_{f}").alias("importance"))
            )
    scored = rows.agg(*scores)
    return M.importance_ranks(scored.select(F.inline(F.array(*entries))), **top)


def importance_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five of the candidates, training rows against test rows."""
    return M.importance_delta(_importance_ranks(_split(spark, sf_dir), CANDIDATES, top=5), "train", "test")


NUMERIC = [f for f in ML.feature_set(8) if f not in ML.CATEGORICAL]


def importance_delta_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top list, as long as the operator's default, over every numeric feature of the set, meet-by-meet rating included."""
    rows = ML.eligible_for_model(meet_rated_layer(spark, sf_dir), TARGET)
    rows = ML.encode_categories(ML.temporal_split(rows))
    return M.importance_delta(_importance_ranks(rows, NUMERIC, M.correlation), "train", "test")


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole metrics row of one simple prediction."""
    rows = _split(spark, sf_dir)
    return rounded(M.model_metrics(rows, rows.filter("split = 'test'"), TARGET, "pred", 1))


VERSIONS = {"v08": -0.5, "v09": -0.25, "v10": 0.0}


def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shrinkages of one simple prediction as versions, overall and per segment."""
    rows, tables = _split(spark, sf_dir).filter("split = 'test'"), {}
    dims = {"overall": F.lit("all"), **ML.segment_dims()}
    for version, factor in VERSIONS.items():
        tables[version] = M.segment_metrics(rows.withColumn("pred", F.col("prev_pct_change") * factor), TARGET, "pred", dims)
    return rounded(ML.compare_versions(tables, TARGET))


def version_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics rows of the three versions, each beside the one before."""
    rows, stacked = _split(spark, sf_dir), None
    for n, (version, factor) in enumerate(VERSIONS.items(), 1):
        scored = rows.filter("split = 'test'").withColumn("pred", F.col("prev_pct_change") * factor)
        row = M.model_metrics(rows, scored, TARGET, "pred", n, 10 * n).withColumns({"version": F.lit(version), "target": F.lit(TARGET)})
        stacked = row if stacked is None else stacked.unionByName(row)
    return rounded(M.version_comparison(stacked))


# --- fits: no SQL twin ----------------------------------------------------------

FEATURES = ML.feature_set(10)


def _rated_split(spark: SparkSession, sf_dir: str, features=FEATURES) -> DataFrame:
    return ML.temporal_split(ML.model_frame(meet_rated_layer(spark, sf_dir), TARGET, features))


_FITTED: dict[tuple[str, str], ML.Fitted] = {}


def _fitted(spark: SparkSession, sf_dir: str) -> ML.Fitted:
    """The fit that two queries show, made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = ML.train_gbt(_rated_split(spark, sf_dir), TARGET, FEATURES)
    return _FITTED[key]


def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).predictions


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.feature_importance(_fitted(spark, sf_dir), spark, "v10").orderBy(F.desc("importance"), "feature")


def param_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many trials of the reference's search space as the job tries."""
    return ML.param_search(_rated_split(spark, sf_dir), TARGET, FEATURES, ML.random_trials(ML.JOB_TRIALS))


def dual_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, *_ = ML.dual_target(meet_rated_layer(spark, sf_dir), FEATURES)
    return predictions


QUERIES = {
    "model_frame": model_frame,
    "temporal_split": temporal_split,
    "baseline_rmse": baseline_rmse,
    "regression_metrics": regression_metrics,
    "scale_free_metrics": scale_free_metrics,
    "segment_eval": segment_eval,
    "prediction_table": prediction_table,
    "prediction_overlap": prediction_overlap,
    "importance_delta": importance_delta,
    "importance_delta_all": importance_delta_all,
    "model_metrics": model_metrics,
    "version_comparison": version_comparison,
    "version_table": version_table,
    "train_gbt": train_gbt,
    "feature_importance": feature_importance,
    "param_search": param_search,
    "dual_target": dual_target,
}

_MODEL = {
    "sex_encoded": "CAST(CASE sex WHEN 'M' THEN 1 ELSE 0 END AS INTEGER)",
    "age_class_encoded": "CAST(CASE WHEN age_class IS NULL THEN NULL "
    + "".join(f"WHEN age_class = '{k}' THEN {v} " for k, v in ML.SETTINGS.age_class_midpoint.items())
    + "END AS DOUBLE)",
    "ipf_wc_numeric": "CAST(replace(replace(ipf_weight_class, '+', ''), 'unknown', '0') AS DOUBLE)",
    "is_origin_country_int": "CAST(is_origin_country AS INTEGER)",
    "time_gap_category": "CAST(time_gap_category AS INTEGER)",
}
_KEEP = {"parent_federation", "cumulative_comps", "tenure", "approx_age", "abs_years_from_peak_age"}
_FRAME = ", ".join(
    f"{_MODEL[f]} AS {f}" if f in _MODEL else f if f in _KEEP else sql.r(f, digits=4) for f in FRAME
)
_ELIGIBLE = f"SELECT * FROM base WHERE {TARGET} IS NOT NULL AND time_since_last_comp_years >= 0.15"
_CUTS = """SELECT (list(date ORDER BY date))[CAST(floor(count(*) * CAST(0.67 AS DOUBLE)) AS BIGINT) + 1] AS c1,
  (list(date ORDER BY date))[CAST(floor(count(*) * CAST(0.75 AS DOUBLE)) AS BIGINT) + 1] AS c2 FROM e"""
_SPLIT = f"""SELECT e.*, CASE WHEN date <= c1 THEN 'train' WHEN date <= c2 THEN 'val' ELSE 'test' END AS split,
  prev_pct_change * -0.5 AS pred, prev_pct_change_dots * -0.5 AS pred_dots, {TARGET} AS y,
  CASE sex WHEN 'M' THEN 'M' ELSE 'F' END AS dim_sex, replace(replace(ipf_weight_class, '+', ''), 'unknown', '0') AS dim_wc,
  ['Beginner', 'Intermediate', 'Advanced', 'Elite', 'World Class'][starting_tier + 1] AS dim_tier FROM e, cuts"""
_PARTS = {"e": _ELIGIBLE, "cuts": _CUTS, "s": _SPLIT}
_R2 = "1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(y), 0)"


def _q(select: str, **more: str) -> str:
    return sql.query(select, **_PARTS, **more)


_T = "SELECT * FROM s WHERE split = 'test' AND pred IS NOT NULL"


def _dim_metrics(source: str, extra: str = "", overall: bool = False) -> str:
    dims = {"sex": "dim_sex", "weight_class": "dim_wc", "starting_tier": "dim_tier"}
    dims = {**({"overall": "'all'"} if overall else {}), **dims}
    group = f"{extra} " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {group}'{d}' AS dim, {c} AS value, count(*) AS n, sqrt(avg((y - pred) * (y - pred))) AS rmse, {_R2} AS r2 "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {'version, ' if extra else ''}{c} HAVING count(*) >= 50"
        for d, c in dims.items()
    )


_VERSIONED = " UNION ALL ".join(
    f"SELECT * REPLACE (prev_pct_change * {k} AS pred), '{v}' AS version FROM s WHERE split = 'test' AND prev_pct_change IS NOT NULL"
    for v, k in VERSIONS.items()
)
_CORR = " UNION ALL ".join(
    f"SELECT '{v}' AS version, '{f}' AS feature, abs(corr(y, CAST({f} AS DOUBLE))) AS importance FROM s{w}"
    for v, w in (("train", " WHERE split = 'train'"), ("test", " WHERE split = 'test'"))
    for f in CANDIDATES
)

_NUMERIC = ", ".join(f"{_MODEL[f]} AS {f}" if f in _MODEL else f for f in NUMERIC)
_FREE = """SELECT sqrt(avg((y - pred) * (y - pred))) / stddev_pop(y) AS rmse_normalised, covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0) AS spearman_rho FROM (SELECT *,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
  rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rp FROM t)"""
_AROUND = {
    "lifted": "SELECT sqrt(avg(pow(y - m, 2))) AS b FROM s, (SELECT avg(y) AS m FROM s WHERE split = 'train') WHERE split = 'test'",
    "parted": "SELECT "
    + ", ".join(f"count(*) FILTER (WHERE split = '{part}') AS n_{part}" for part in ("train", "val", "test"))
    + " FROM s",
}
_MEASURES = (
    ["mse", "rmse", "mae", "r2", "median_ae", "baseline_rmse", "rmse_lift", "rmse_normalised", "spearman_rho"],
    ["n", "n_train", "n_val", "n_test", "n_features", "n_trials"],
)
_SHOWN = ", ".join([*(f"round({c}, 6) AS {c}" for c in _MEASURES[0]), *_MEASURES[1]])


def _row(source: str, features: int, trials: int) -> str:
    """The metrics row of the test rows in ``source``."""
    return f"""SELECT count(*) AS n, avg((y - pred) * (y - pred)) AS mse, sqrt(avg((y - pred) * (y - pred))) AS rmse,
  avg(abs(y - pred)) AS mae, {_R2} AS r2, median(abs(y - pred)) AS median_ae, max(b) AS baseline_rmse,
  max(b) - sqrt(avg((y - pred) * (y - pred))) AS rmse_lift, max(rmse_normalised) AS rmse_normalised, max(spearman_rho) AS spearman_rho,
  max(n_train) AS n_train, max(n_val) AS n_val, max(n_test) AS n_test, {features}::BIGINT AS n_features, {trials}::BIGINT AS n_trials
FROM {source}, lifted, ({_FREE.replace("FROM t)", f"FROM {source})")}), parted"""


def _versions() -> str:
    parts = (
        f"SELECT *, '{v}' AS version, '{TARGET}' AS target FROM ({_row(f"(SELECT * FROM vt WHERE version = '{v}')", n, 10 * n)})"
        for n, v in enumerate(VERSIONS, 1)
    )
    return " UNION ALL ".join(parts)


SQL = {
    "model_frame": sql.query(
        f"SELECT primary_key, meet_name, name, date, {_FRAME}, CAST(starting_tier AS INTEGER) AS starting_tier, "
        f"round(greatest(least({TARGET}, hi), lo), 4) AS {TARGET} FROM e JOIN rated USING (primary_key, date, meet_name), b",
        recursive=True,
        **sql.rating_parts("quarter", "meet_name, sex, ipf_weight_class"),
        e=_ELIGIBLE,
        b=f"SELECT {sql.nearest(TARGET, 0.01)} AS lo, {sql.nearest(TARGET, 0.99)} AS hi FROM e",
    ),
    "temporal_split": _q("SELECT primary_key, date, meet_name, split FROM s"),
    "baseline_rmse": _q(
        "SELECT count(*) AS n_test, round(max(m), 6) AS baseline_prediction, round(sqrt(avg(pow(y - m, 2))), 6) AS baseline_rmse "
        "FROM s, (SELECT avg(y) AS m FROM s WHERE split = 'train') WHERE split = 'test'"
    ),
    "regression_metrics": _q(
        f"""SELECT count(*) AS n, round(avg((y - pred) * (y - pred)), 6) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
  round(avg(abs(y - pred)), 6) AS mae, round({_R2}, 6) AS r2, round(median(abs(y - pred)), 6) AS median_ae FROM t""",
        t=_T,
    ),
    "scale_free_metrics": _q(
        """SELECT round(sqrt(avg((y - pred) * (y - pred))) / stddev_pop(y), 6) AS rmse_normalised,
  round(corr(ry, rp), 6) AS spearman_rho FROM (SELECT *,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
  rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rp FROM t)""",
        t=_T,
    ),
    "segment_eval": _q(
        f"SELECT dim, value, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM ({_dim_metrics('p')})",
        p="SELECT * FROM s WHERE pred IS NOT NULL",
    ),
    "prediction_table": _q(
        """SELECT coalesce(a.primary_key, b.primary_key) AS primary_key, coalesce(a.date, b.date) AS date,
  coalesce(a.meet_name, b.meet_name) AS meet_name, round(a.pred, 6) AS pred, round(b.pred_dots, 6) AS pred_dots,
  CAST(coalesce(a.starting_tier, b.starting_tier) AS INTEGER) AS starting_tier
FROM t a FULL JOIN u b ON a.primary_key = b.primary_key AND a.date = b.date AND a.meet_name = b.meet_name""",
        t=_T,
        u="SELECT * FROM s WHERE split = 'test' AND pred_dots IS NOT NULL",
    ),
    "prediction_overlap": _q(
        """SELECT count(*) FILTER (WHERE pred IS NOT NULL AND pred_dots IS NULL) AS first_only,
  count(*) FILTER (WHERE pred IS NULL AND pred_dots IS NOT NULL) AS second_only,
  count(*) FILTER (WHERE pred IS NOT NULL AND pred_dots IS NOT NULL) AS both FROM s WHERE split = 'test'"""
    ),
    "importance_delta": _q(
        """SELECT o.feature, CAST(o.rank AS INTEGER) AS rank, 'dropped out' AS change FROM k o
  WHERE o.version = 'train' AND o.feature NOT IN (SELECT feature FROM k WHERE version = 'test')
UNION ALL SELECT o.feature, CAST(o.rank AS INTEGER), 'entered' FROM k o
  WHERE o.version = 'test' AND o.feature NOT IN (SELECT feature FROM k WHERE version = 'train')""",
        i=_CORR,
        k="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY importance DESC, feature) AS rank FROM i) WHERE rank <= 5",
    ),
    "importance_delta_all": sql.query(
        """SELECT o.feature, CAST(o.rank AS INTEGER) AS rank, 'dropped out' AS change FROM k o
  WHERE o.version = 'train' AND o.feature NOT IN (SELECT feature FROM k WHERE version = 'test')
UNION ALL SELECT o.feature, CAST(o.rank AS INTEGER), 'entered' FROM k o
  WHERE o.version = 'test' AND o.feature NOT IN (SELECT feature FROM k WHERE version = 'train')""",
        recursive=True,
        **sql.meet_rating_parts("date, meet_name, sex, ipf_weight_class"),
        e=_ELIGIBLE,
        cuts=_CUTS,
        sr=f"""SELECT {_NUMERIC}, CASE WHEN date <= c1 THEN 'train' WHEN date <= c2 THEN 'val' ELSE 'test' END AS split, {TARGET} AS y
  FROM e JOIN (SELECT *, lag(elo_change) OVER (PARTITION BY primary_key ORDER BY date, meet_name) AS prev_elo_change FROM rated) r
  USING (primary_key, date, meet_name), cuts""",
        i=" UNION ALL ".join(
            f"SELECT '{v}' AS version, '{f}' AS feature, abs(covar_pop(y, x) / nullif(stddev_pop(x) * stddev_pop(CASE WHEN x IS NOT NULL "
            f"THEN y END), 0)) AS importance FROM (SELECT y, CAST({f} AS DOUBLE) AS x FROM sr WHERE split = '{v}')"
            for v in ("train", "test")
            for f in NUMERIC
        ),
        k="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY importance DESC NULLS LAST, feature) AS rank FROM i)
  WHERE rank <= 15""",
    ),
    "model_metrics": _q(f"SELECT {_SHOWN} FROM ({_row('t', 1, 1)})", t=_T, **_AROUND),
    "version_table": _q(
        f"""SELECT {_SHOWN}, version, target, round(r2 - lag(r2) OVER w, 6) AS r2_delta, round(rmse - lag(rmse) OVER w, 6) AS rmse_delta
FROM ({_versions()}) WINDOW w AS (ORDER BY version)""",
        vt=_VERSIONED,
        **_AROUND,
    ),
    "version_comparison": _q(
        f"""SELECT version, '{TARGET}' AS target, dim, value, n, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
  round(r2 - lag(r2) OVER w, 6) AS r2_delta, round(rmse - lag(rmse) OVER w, 6) AS rmse_delta
FROM ({_dim_metrics('v', 'version,', True)}) WINDOW w AS (PARTITION BY dim, value ORDER BY version)""",
        v=_VERSIONED,
    ),
}
