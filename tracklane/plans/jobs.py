"""The batch jobs from a results CSV to tables and models.

``python -m tracklane.plans.jobs --lake URI [--csv PATH] [--reference DIR] [job ...]``
runs the named jobs in the order given, or all of them. Each job reads the layer
before it, so each can be scheduled on its own.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.config import SETTINGS, Settings
from tracklane.operators import analyses as A
from tracklane.operators import describe as D
from tracklane.operators import metrics as M
from tracklane.operators import model as ML
from tracklane.operators.clean import drop_report, quality_rules
from tracklane.plans.base import MEET, base_events, base_table
from tracklane.plans.raw import REPEAT_KEYS, raw_results
from tracklane.runtime import store
from tracklane.sources.csv_files import convert_reference_tables, land_csv
from tracklane.sources.layers import Lake
from tracklane.sources.schemas import REFERENCE

RESULTS = "results"
ENTITY_ORDER = ["primary_key", "date"]

# Names of the report tables.
REPORTS = {
    "describe_by_weight_class": D.progress_by_segment,
    "describe_by_experience": D.progress_by_experience,
    "describe_by_sex_wc_experience": D.progress_by_segment_and_experience,
    "describe_quality": D.quality_report,
    "analysis_career_trajectory": A.career_trajectory,
    "analysis_comp_indexed_growth": A.indexed_growth,
    "analysis_percentile_movement": A.percentile_movement,
    "analysis_rolling_averages": A.rolling_summary,
    "analysis_lift_ratios": A.part_ratios,
    "analysis_wilks_trajectory": A.score_trajectory,
    "analysis_survival": A.milestone_attainment,
    "describe_score_norms": D.score_norms,
    "describe_tier_transitions": D.tier_transitions,
}


def land(spark: SparkSession, lake: Lake, csv: str) -> dict[str, int]:
    return lake.write(land_csv(spark, csv), "landing", RESULTS)


def load_reference(spark: SparkSession, lake: Lake, folder: str) -> dict[str, str]:
    return convert_reference_tables(spark, folder, f"{lake.root}/reference-tables", REFERENCE)


def build_raw(spark: SparkSession, lake: Lake) -> dict[str, int]:
    """Raw layer; stops before it replaces the layer when the origin join repeated a row."""
    raw = store(raw_results(lake.read(spark, "landing", RESULTS)), "raw")
    repeated = raw.groupBy(*REPEAT_KEYS).count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("raw layer: rows repeat on key, date and meet")
    return lake.write(raw, "raw", RESULTS, ENTITY_ORDER)


def build_base(
    spark: SparkSession, lake: Lake, period: str = MEET, settings: Settings = SETTINGS, quality: bool = True
) -> dict[str, int]:
    """Base layer. With ``quality``, rows that break a quality rule are left out and ``quality_drops`` tells how many."""
    raw = lake.read(spark, "raw", RESULTS)
    if quality:
        lake.write(drop_report(base_events(raw), quality_rules(settings)), "base", "quality_drops")
    return lake.write(base_table(raw, period, settings, quality), "base", RESULTS, ENTITY_ORDER)


def build_reports(spark: SparkSession, lake: Lake) -> None:
    base = lake.read(spark, "base", RESULTS)
    for name, report in REPORTS.items():
        lake.write(report(base), "base", name)
    assigned, centroids = A.archetypes(base)
    lake.write(assigned, "base", "analysis_archetypes")
    lake.write(centroids, "base", "analysis_archetype_centroids")


def build_models(
    spark: SparkSession,
    lake: Lake,
    version: int = 11,
    trials: Sequence[ML.Trial] | None = None,
    prior_best: dict[str, float] | None = None,
) -> DataFrame:
    """Both targets: search, fit of the best trial, evaluation tables, and the guard against regressions.

    Without ``trials``, ``JOB_TRIALS`` draws from the search space are tried. Written per version: predictions,
    segments, importances and the search. Metrics are appended; the comparison of all versions is written anew.
    """
    base = lake.read(spark, "base", RESULTS)
    trials = list(trials) if trials is not None else ML.random_trials(ML.JOB_TRIALS)
    found = ML.dual_target(base, ML.feature_set(version), trials=trials)
    lake.write(found.predictions.drop("meet_name"), "base", f"model_predictions_v{version}")
    for name, table in (("segments", found.segments), ("importance", found.importances), ("search", found.searches)):
        if table is not None:
            lake.write(table, "base", f"model_{name}_v{version}")
    scores = store(found.scores.selectExpr(f"'v{version:02d}' AS version", "*"), "scores")
    lake.append(scores, "base", "model_metrics")
    latest = lake.read(spark, "base", "model_metrics").groupBy("version", "target")
    measures = [F.last(c).alias(c) for c in scores.columns if c not in ("version", "target")]
    lake.write(M.version_comparison(latest.agg(*measures)), "base", "model_versions")
    M.regression_guard(scores, prior_best or {})
    return scores


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--lake", required=True, help="root folder or URI of the layers")
    parser.add_argument("--csv", help="results CSV for the land job")
    parser.add_argument("--reference", help="folder of reference CSVs")
    parser.add_argument("--period", default=MEET, help="rate meet by meet, or all meets of a month, quarter or year from one start")
    parser.add_argument("--keep-implausible", action="store_true", help="keep rows that break a quality rule")
    parser.add_argument("--trials", type=int, default=ML.JOB_TRIALS, help="draws from the search space")
    parser.add_argument("jobs", nargs="*", help="land, reference, raw, base, reports, models")
    args = parser.parse_args(argv)
    spark, lake = SparkSession.builder.appName("tracklane").getOrCreate(), Lake(args.lake)
    jobs = {
        "land": lambda: land(spark, lake, args.csv),
        "reference": lambda: load_reference(spark, lake, args.reference),
        "raw": lambda: build_raw(spark, lake),
        "base": lambda: build_base(spark, lake, args.period, quality=not args.keep_implausible),
        "reports": lambda: build_reports(spark, lake),
        "models": lambda: build_models(spark, lake, trials=ML.random_trials(args.trials)),
    }
    given = {"land": args.csv, "reference": args.reference}
    chosen = args.jobs or [name for name in jobs if given.get(name, True)]
    for name in chosen:
        jobs[name]()


if __name__ == "__main__":
    main()
