"""Constants used by the operators, in one object."""

from __future__ import annotations

from dataclasses import dataclass, field

INF = float("inf")


@dataclass(frozen=True)
class Settings:
    # They decide the results and must not drift.
    age_tolerance_years: int = 2
    days_in_year: float = 365.25
    min_events: int = 3
    min_gap_days: int = 30
    train_cutoff: float = 0.67
    val_cutoff: float = 0.75
    model_min_gap_years: float = 0.15
    winsor_bounds: tuple[float, float] = (0.01, 0.99)
    peak_age: int = 29
    gap_short_days: int = 90
    gap_medium_days: int = 365
    rating_initial: float = 1500.0
    rating_k: float = 32.0
    rating_multiplier: dict[int, float] = field(default_factory=lambda: {1: 1.5, 2: 1.0, 3: 0.8, 4: 0.6})
    tenure_breaks: tuple[int, ...] = (180, 365, 730, 1095, 1825, 2555, 3650)
    tenure_labels: tuple[str, ...] = ("0-6mo", "6-12mo", "1-2yr", "2-3yr", "3-5yr", "5-7yr", "7-10yr", "10yr+")
    experience_breaks: tuple[int, ...] = (3, 8, 15)
    experience_labels: tuple[str, ...] = ("novice (1-3)", "intermediate (4-8)", "experienced (9-15)", "veteran (16+)")
    milestones: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {"M": (300, 400, 500, 600, 700), "F": (150, 200, 250, 300, 350)}
    )
    clusters: int = 5
    cluster_restarts: int = 10
    cluster_seed: int = 42
    cluster_steps: int = 30
    max_event_no: int = 20
    weight_classes: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "M": (59, 66, 74, 83, 93, 105, 120, INF),
            "F": (47, 52, 57, 63, 69, 76, 84, INF),
        }
    )
    bodyweight_range: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {"M": (40.0, 210.0), "F": (40.0, 150.0)}
    )
    total_tolerance: float = 2.5
    tier_bounds: tuple[float, ...] = (200.0, 300.0, 400.0, 500.0)
    tier_names: tuple[str, ...] = ("Beginner", "Intermediate", "Advanced", "Elite", "World Class")
    # Quartic denominators of the DOTS score, highest power first.
    dots_coefficients: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "M": (-0.000001093, 0.0007391293, -0.1918759221, 24.0900756, -307.75076),
            "F": (-0.0000010706, 0.0005158568, -0.1126655495, 13.6175032, -57.96288),
        }
    )
    age_class_midpoint: dict[str, float] = field(
        default_factory=lambda: {
            "5-12": 9.0,
            "13-15": 14.0,
            "16-17": 16.5,
            "18-19": 18.5,
            "20-23": 21.5,
            "24-34": 29.0,
            "35-39": 37.0,
            "40-44": 42.0,
            "45-49": 47.0,
            "50-54": 52.0,
            "55-59": 57.0,
            "60-64": 62.0,
            "65-69": 67.0,
            "70-74": 72.0,
            "75-79": 77.0,
            "80-999": 85.0,
        }
    )
    sex_code: dict[str, int] = field(default_factory=lambda: {"M": 1, "F": 0, "Mx": 0})
    min_segment_rows: int = 50
    regression_tolerance: float = 0.02
    null_rate_threshold: float = 0.01


SETTINGS = Settings()
