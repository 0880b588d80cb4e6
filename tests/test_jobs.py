"""Every job in turn, from a CSV to models, on a small generated file."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from tracklane.operators import model as ML
from tracklane.operators.metrics import RegressionGuardError
from tracklane.operators.model import Trial
from tracklane.plans import jobs
from tracklane.sources.layers import Lake
from tracklane.sources.schemas import LANDING_TYPES

QUICK = [Trial(max_depth=2, max_iter=2), Trial(max_depth=3, max_iter=4)]


def write_csv(path, people=40):
    draw = random.Random(9)
    lines = [",".join("".join(w.capitalize() for w in c.split("_")) for c in LANDING_TYPES)]
    for p in range(people):
        sex, born, day = draw.choice(["M", "F"]), draw.randint(1985, 1998), date(2018, 1, draw.randint(1, 28))
        for _ in range(draw.randint(3, 8)):
            day += timedelta(days=draw.choice([20, 70, 120, 200, 400]))
            lifts = [draw.randint(60, 110) * 2.5 for _ in range(3)]
            row = {
                **dict.fromkeys(LANDING_TYPES, ""),
                "date": day.isoformat(),
                "name": f"Person {p:03d}",
                "sex": sex,
                "place": draw.choice(["1", "2", "3", "DQ"]) if draw.random() < 0.3 else "1",
                "age": str(day.year - born + 0.5),
                "age_class": "24-34",
                "bodyweight_kg": str(draw.choice([60.0, 74.5, 82.0, 92.0])),
                "event": "SBD",
                "meet_country": draw.choice(["AU", "NZ"]),
                "equipment": "Raw",
                "best3_squat_kg": str(lifts[0]),
                "best3_bench_kg": str(lifts[1]),
                "best3_deadlift_kg": str(lifts[2]),
                "total_kg": str(sum(lifts)),
                "wilks": str(sum(lifts) / 2),
                "tested": "Yes",
                "federation": "PA",
                "meet_name": draw.choice(["State Titles", "National Open", ""]),
                "parent_federation": draw.choice(["IPF", ""]),
            }
            lines.append(",".join(row.values()))
    path.write_text("\n".join(lines) + "\n")


def test_jobs_from_csv_to_models(spark, tmp_path):
    write_csv(tmp_path / "results.csv")
    lake = Lake(str(tmp_path / "lake"))
    landed = jobs.land(spark, lake, str(tmp_path / "results.csv"))
    raw = jobs.build_raw(spark, lake)
    assert 0 < raw["rows"] < landed["rows"] and raw["nulls_primary_key"] == 0
    base = jobs.build_base(spark, lake, period="quarter")
    assert 0 < base["rows"] <= raw["rows"] and base["nulls_elo_rating"] == 0
    table = lake.read(spark, "base", jobs.RESULTS)
    drops = {r.rule: r for r in lake.read(spark, "base", "quality_drops").collect()}
    assert set(drops) == {"bombout", "total_consistency", "bodyweight"} and drops["bombout"].rows_dropped == 0
    assert {"elo_rating", "prev_elo_change", "total_percentile_rank", "max_tier_so_far"} <= set(table.columns)

    jobs.build_reports(spark, lake)
    for name in [*jobs.REPORTS, "analysis_archetypes", "analysis_archetype_centroids"]:
        assert lake.read(spark, "base", name).count() > 0, name

    scores = jobs.build_models(spark, lake, trials=QUICK)
    assert {r.target for r in scores.collect()} == set(ML.TARGETS)
    assert {"baseline_rmse", "rmse_lift", "n_train", "n_val", "n_test", "n_features", "n_trials", "rounds", "spearman_rho"} <= set(scores.columns)
    predictions = lake.read(spark, "base", "model_predictions_v11")
    assert set(predictions.columns) == {"primary_key", "date", "pred_pct_change_total", "pred_pct_change_dots", "starting_tier"}
    search = lake.read(spark, "base", "model_search_v11").collect()
    assert len(search) == 4 and {r.target for r in search} == set(ML.TARGETS)
    importance = lake.read(spark, "base", "model_importance_v11")
    assert importance.filter("target = 'pct_change_dots'").count() == len(ML.feature_set(11))
    assert {"target", "dim", "value", "rmse"} <= set(lake.read(spark, "base", "model_segments_v11").columns)
    with pytest.raises(RegressionGuardError):
        jobs.build_models(spark, lake, version=9, trials=QUICK, prior_best={"pct_change_total": 0.99})
    assert lake.read(spark, "base", "model_metrics").count() == 4
    versions = lake.read(spark, "base", "model_versions").collect()
    assert {(r.version, r.target) for r in versions} == {(v, t) for v in ("v09", "v11") for t in ML.TARGETS}
    assert {r.version: r.r2_delta is None for r in versions} == {"v09": True, "v11": False}
