"""Policy values that the rules and monitors read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DriftPolicy:
    """Starting policy for monitoring; calibrate on validation data, never on test data."""

    # fixed values: the published defaults of the monitored system
    ewma_lambda: float = 0.25
    ewma_limit_sigma: float = 3.0
    cusum_k_sigma: float = 0.25
    cusum_h_sigma: float = 4.0
    psi_medium: float = 0.10
    psi_high: float = 0.25
    min_signals: int = 2
    drop_review: float = 2.0
    drop_incident: float = 5.0
    drop_block: float = 10.0
    canary_max_disagreement: float = 0.05
    canary_min_recall_delta: float = -0.02

    def __post_init__(self) -> None:
        if not 0.0 < self.ewma_lambda <= 1.0:
            raise ValueError("ewma_lambda must lie in (0, 1]")
        if self.psi_medium >= self.psi_high:
            raise ValueError("psi_medium must be below psi_high")
        if self.min_signals < 1:
            raise ValueError("min_signals must be at least 1")
        if not 0.0 <= self.canary_max_disagreement <= 1.0:
            raise ValueError("canary_max_disagreement must lie in [0, 1]")


@dataclass(frozen=True)
class GatePolicy:
    """Limits of the input quality gate."""

    # fixed values: the published defaults of the monitored system
    min_width: int = 64
    min_height: int = 64
    min_aspect: float = 0.1
    max_aspect: float = 10.0
    min_std: float = 2.0
    blur_review: float = 20.0
    dark_review: float = 12.0
    bright_review: float = 243.0


DEFAULT_POLICY = DriftPolicy()
DEFAULT_GATE = GatePolicy()
