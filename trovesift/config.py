"""Tunables of the engine in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass

#: Reference instant of all time decay: results never depend on the wall clock.
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Settings:
    """Weights and limits of retrieval, ranking, feedback and learning."""

    # Lexical search
    name_weight: float = 10.0
    path_weight: float = 5.0
    content_weight: float = 0.5
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    content_score_scale: float = 0.6
    # Fixed boosts of match types
    exact_name: float = 200.0
    prefix_name: float = 150.0
    contains_name: float = 100.0
    exact_path: float = 90.0
    prefix_path: float = 80.0
    fuzzy: float = 30.0
    # Signals
    recency_weight: float = 30.0
    recency_days: float = 7.0
    frequency_tiers: tuple[float, float, float] = (10.0, 20.0, 30.0)
    frequency_half_days: float = 30.0
    cwd_weight: float = 25.0
    cwd_depth: int = 2
    app_weight: float = 15.0
    pinned_weight: float = 200.0
    junk_weight: float = 50.0
    # Fusion
    rrf_k: int = 60
    passage_cap: int = 3
    # Feedback and learning
    feedback_days: int = 90
    interaction_days: int = 180
    affinity_days: int = 30
    ltr_min_interactions: int = 200
    learning_rate: float = 0.05
    epochs: int = 3
    l2: float = 1e-4


DEFAULTS = Settings()
