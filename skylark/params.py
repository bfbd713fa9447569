"""Thresholds with their defaults. Times are relative to an explicit as_of, never to the wall clock."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Decay:
    # Decay per hour by stream, start values and the floor.
    per_hour: dict = field(default_factory=lambda: {"CRIME_INTEL": 0.02, "INFRASTRUCTURE": 0.006, "PRIORITY": 0.003})
    default: float = 0.012
    priority_start: float = 1.5
    floor: float = 0.05
    high: float = 0.6
    low: float = 0.2


@dataclass(frozen=True)
class Correlation:
    max_km: float = 50.0
    max_hours: float = 24.0
    window_hours: int = 48
    min_score: float = 0.70


@dataclass(frozen=True)
class Anomaly:
    baseline_days: int = 30
    min_days: int = 7
    min_std: float = 0.5
    z: float = 2.0
    steepness: float = 0.7
    ceiling: float = 0.95


@dataclass(frozen=True)
class Entropy:
    epoch_days: int = 30
    step: float = 0.05
    floor: float = 0.10


@dataclass(frozen=True)
class Coalition:
    min_shared: int = 5


@dataclass(frozen=True)
class Emergence:
    min_count: int = 3
    min_growth: float = 2.0


AS_OF = "2024-01-31 00:00:00"
EARTH_KM = 6371.0
