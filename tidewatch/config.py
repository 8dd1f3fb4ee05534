"""Tunable settings. The numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ThresholdSettings:
    # Static limits of the threshold rules.
    pps: float = 10_000
    bps: float = 100_000_000
    fps: float = 5_000
    pps_per_ip: float = 5_000
    connections_per_ip: float = 1_000
    entropy_floor: float = 0.7
    entropy_margin: float = 0.2
    syn_ratio: float = 0.8
    syn_min_pps: float = 5_000
    udp_ratio: float = 0.7
    udp_min_pps: float = 10_000
    icmp_ratio: float = 0.5
    icmp_min_pps: float = 5_000
    dynamic: bool = True
    history: int = 60
    min_history: int = 10
    sigmas: float = 3.0
    cooldown_seconds: int = 30
    min_window_seconds: int = 5


@dataclass(frozen=True)
class FloodLimits:
    # Indicator limits of a window.
    tcp_share: float = 0.5
    syn_ratio: float = 0.8
    syn_sources: int = 100
    syn_pps: float = 10_000
    udp_share: float = 0.8
    udp_pps: float = 15_000
    icmp_share: float = 0.6
    icmp_pps: float = 5_000
    http_per_second: float = 1_000


@dataclass(frozen=True)
class RollingSettings:
    # Rolling baseline over recent non-empty windows.
    history: int = 50
    min_history: int = 10
    sigmas: float = 3.0


@dataclass(frozen=True)
class EnsembleSettings:
    # Detector weights and gates.
    weights: dict[str, float] = field(default_factory=lambda: {"threshold": 0.4, "ml": 0.4, "entropy": 0.2})
    other_weight: float = 0.1
    min_confidence: float = 0.6
    min_votes: int = 2
    cascade_ml: float = 0.7
    entropy_limit: float = 0.6
    throttle_gap_seconds: int = 10
    throttle_per_minute: int = 60


@dataclass(frozen=True)
class FlowSettings:
    # Session timeouts and history lengths.
    idle_seconds: int = 30
    active_seconds: int = 60
    size_history: int = 100
    gap_history: int = 1000
    gap_limit_seconds: int = 60
    snapshot_gap_ms: int = 250


@dataclass(frozen=True)
class RedirectSettings:
    # Volume and duration that justify a redirect.
    min_pps: float = 50_000
    min_bps: float = 1_000_000_000
    min_seconds: int = 30
    rollback_seconds: int = 3600
    scrubber: str = "192.0.2.1"
    asn: int = 64512
    priority: int = 100


@dataclass(frozen=True)
class ShieldSettings:
    # Volume that makes an address a shield candidate.
    min_pps: float = 50_000
    min_bps: float = 100_000_000
    cooldown_seconds: int = 300


@dataclass(frozen=True)
class DriftSettings:
    # Drift and degradation levels.
    ks_threshold: float = 0.05
    low: float = 0.05
    medium: float = 0.15
    slight: float = -0.05
    moderate: float = -0.10
    severe: float = -0.20
    error_rate_change: float = 0.1
    last_checks: int = 10
    retrain_ratio: float = 0.3
    trend_slope: float = 0.01


# Severity order.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
