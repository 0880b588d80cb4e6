from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tracklane.operators import model as ML

FEATURES = ["x1", "x2", "parent_federation"]


def rows_of(n=400):
    draw, rows = random.Random(2), []
    for i in range(n):
        x1, x2 = draw.uniform(0, 10), draw.choice([None, draw.uniform(0, 5)])
        y = 3 * x1 + (x2 or 0) + draw.gauss(0, 0.1)
        day = date(2020, 1, 1) + timedelta(days=draw.randint(0, 50))
        rows.append((f"e{i}", "m", "n", day, x1, x2, draw.choice(["A", "B"]), draw.randint(0, 4), y))
    return rows


SCHEMA = (
    "primary_key string, meet_name string, name string, date date, x1 double, x2 double, parent_federation string, "
    "starting_tier int, y double"
)


@pytest.fixture(scope="module")
def split(spark):
    return ML.temporal_split(spark.createDataFrame(rows_of(), SCHEMA)).cache()


def test_split_dates_are_those_of_the_sorted_list(spark, split):
    days = sorted(r[3] for r in rows_of())
    c1, c2 = days[int(len(days) * 0.67)], days[int(len(days) * 0.75)]
    want = {"train": sum(d <= c1 for d in days), "val": sum(c1 < d <= c2 for d in days), "test": sum(d > c2 for d in days)}
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == want


def test_winsorize_clips_and_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    got = [r.x for r in ML.winsorize(df, "x").collect()]
    assert got.count(None) == 1
    known = [v for v in got if v is not None]
    assert (min(known), max(known), len(known)) == (1.0, 99.0, 101)


def test_feature_sets():
    assert len(ML.feature_set(8, post_event=True)) == 34
    assert "elo_change" not in ML.feature_set(8) and "prev_elo_change" in ML.feature_set(8)
    assert len(ML.feature_set(10)) == 34 + 5 + 18
    assert len(set(ML.feature_set(10))) == len(ML.feature_set(10))


QUICK = ML.Trial(max_depth=3, max_iter=12, step_size=0.5, subsample=1.0, feature_share=1.0)


def test_gbt_learns_and_reports_importance(spark, split):
    fitted = ML.train_gbt(split, "y", FEATURES, QUICK)
    scored = fitted.predictions.cache()
    scores = ML.M.model_metrics(split, scored, "y", "pred", len(FEATURES)).first()
    parts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert scores.n == scores.n_test == parts["test"] and (scores.n_train, scores.n_val) == (parts["train"], parts["val"])
    assert scores.r2 > 0.8 and scores.rmse_lift == pytest.approx(scores.baseline_rmse - scores.rmse) and scores.rmse_lift > 0
    found = {r.feature: r for r in ML.feature_importance(fitted, spark).collect()}
    assert set(found) == set(FEATURES)
    assert max(found, key=lambda f: found[f].importance) == "x1"
    assert sum(r.importance for r in found.values()) == pytest.approx(1.0)
    assert all(r.unused == (r.splits == 0) for r in found.values()) and found["x1"].gain > 0


def test_gbt_takes_many_categories_and_unseen_ones(spark):
    rows = [(*r[:6], f"F{i % 120}" if r[3] < date(2020, 2, 10) else f"late{i % 3}", *r[7:]) for i, r in enumerate(rows_of(600))]
    split = ML.temporal_split(spark.createDataFrame(rows, SCHEMA)).cache()
    fitted = ML.train_gbt(split, "y", FEATURES, QUICK)
    assert fitted.predictions.filter("pred IS NULL").count() == 0
    assert fitted.predictions.count() == split.filter("split = 'test'").count()


def test_search_is_sorted_repeatable_and_feeds_the_fit(spark, split):
    assert ML.random_trials(3) == ML.random_trials(3)
    trials = [ML.Trial(max_depth=1, max_iter=3, step_size=1e-6), QUICK]
    found = ML.param_search(split, "y", FEATURES, trials, warmup=2).collect()
    assert [r.trial for r in found] == [1, 0] and found[0].mse < found[1].mse
    assert {r.trial: r.state for r in found} == {0: "pruned", 1: "completed"} and found[0].rounds <= QUICK.max_iter
    assert ML.best_trial(spark.createDataFrame(found), trials) == QUICK


def test_compare_versions(spark):
    def scores(r2):
        return spark.createDataFrame([("overall", "all", 100, 1 - r2, r2)], "dim string, value string, n bigint, rmse double, r2 double")

    table = ML.compare_versions({"v08": scores(0.30), "v09": scores(0.35)}, "kg")
    got = {r.version: r.r2_delta for r in table.collect()}
    assert got == {"v08": None, "v09": pytest.approx(0.05)}


def test_registered_fits_use_the_defaults_of_the_job(spark, monkeypatch):
    import inspect

    from tracklane.plans import jobs
    from tracklane.queries import modelling

    seen = []

    def recorder(name):
        signature = inspect.signature(getattr(ML, name))

        def record(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            seen.append(bound.arguments.get("trial", bound.arguments.get("trials")))
            raise StopIteration

        return record

    for name in ("train_gbt", "param_search", "dual_target"):
        monkeypatch.setattr(ML, name, recorder(name))
    monkeypatch.setattr(modelling, "meet_rated_layer", lambda *a: None)
    monkeypatch.setattr(modelling, "_rated_split", lambda *a: None)
    for query in (modelling.train_gbt, modelling.feature_importance, modelling.dual_target, modelling.param_search):
        with pytest.raises(StopIteration):
            query(spark, "")
    assert seen[:3] == [ML.Trial()] * 3 and ML.Trial().max_iter == 2000
    assert ML.PATIENCE == 50
    assert seen[3] == ML.random_trials(ML.JOB_TRIALS) and "trials" in inspect.signature(jobs.build_models).parameters


def test_search_space():
    trials = ML.random_trials()
    assert len(trials) == 500 and {t.max_depth for t in trials} == set(range(3, 13))
    assert min(t.max_iter for t in trials) == 200 and max(t.max_iter for t in trials) == 2000
    for name in ("step_size", "l1", "l2", "gamma"):
        assert min(getattr(t, name) for t in trials) < 1e-6 and max(getattr(t, name) for t in trials) <= 1
    assert {t.min_child_weight for t in trials} == set(range(1, 31))


def test_importance_delta_ranks_every_numeric_feature(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tracklane.queries import modelling

    assert len(modelling.NUMERIC) == 33 and "elo_rating" in modelling.NUMERIC
    follows = {"train": ["elo_rating"], "test": ["years_competing"]}
    rows = spark.range(40).select(
        F.when(F.col("id") < 20, "train").otherwise("test").alias("split"),
        F.col("id").cast("double").alias(modelling.TARGET),
        *[F.rand(n).alias(f) for n, f in enumerate(modelling.NUMERIC) if f not in ("elo_rating", "years_competing")],
        F.when(F.col("id") < 20, F.col("id")).otherwise(0).alias("elo_rating"),
        F.when(F.col("id") >= 20, F.col("id")).otherwise(0).alias("years_competing"),
    )
    monkeypatch.setattr(modelling, "meet_rated_layer", lambda *a: rows)
    for name in ("eligible_for_model", "temporal_split", "encode_categories"):
        monkeypatch.setattr(ML, name, lambda df, *a: df)
    ranks = modelling._importance_ranks(rows, modelling.NUMERIC, ML.M.correlation)
    assert {v: [r.feature for r in ranks.filter(f"version = '{v}' AND rank = 1").collect()] for v in follows} == follows
    assert ranks.filter("version = 'train'").count() == 15
    found = {(r.feature, r.change) for r in modelling.importance_delta_all(spark, "").collect()}
    assert ("elo_rating", "dropped out") in found and ("years_competing", "entered") in found
