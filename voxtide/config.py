"""Settings of the engine. Values marked *ours* have no documented default and were chosen here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    fetch_batch: int = 400
    lookback_days: int = 14
    cluster_distance: float = 0.15
    retrieval_top_k: int = 10
    rerank_top_k: int = 3
    event_max_age_hours: int = 6
    alert_window_hours: int = 1
    alert_min_incremental: int = 3
    alert_silence_minutes: int = 120
    snapshot_minutes: int = 10
    summary_batch_context: int = 5
    # Ours:
    max_routes: int | None = None
    blocked_codes: tuple[str, ...] = ()
    default_code: str = "default"
    default_line: str = "default"
    route_score: float = 0.5
    text_route_top_k: int = 3
    decay_per_day: float = 0.05
    decision_score: float = 0.6
    false_positive_distance: float = 0.1
    suppress_false_positives: bool = True
    special_thresholds: dict[str, int] = field(default_factory=dict)
    baseline_days: int = 7
    baseline_min_samples: int = 3
    baseline_std_floor: float = 0.5
    snapshot_lookback_hours: int = 72
    missing_activity_days: float = 14.0
    split_members: int = 200
    data_source: str = "feedback"
    unknown_code: str = "unknown"


DEFAULTS = Settings()
