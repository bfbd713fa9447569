"""Score formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylark.params import Anomaly, Decay


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def gravity(severity: Column, actors: Column, frequency: Column, sentiment: Column, credibility: Column) -> Column:
    """Weighted mean of severity, actor importance, frequency, bad sentiment and credibility (0.5 if unknown), with momentum by frequency."""
    base = 0.35 * severity + 0.25 * actors + 0.15 * frequency + 0.15 * (1 - (sentiment + 1) / 2) + 0.10 * F.coalesce(credibility, F.lit(0.5))
    return clamp(base * (0.8 + 0.2 * frequency))


def decayed(stream: Column, is_priority: Column, hours: Column, p: Decay = Decay()) -> Column:
    """Exponential decay by stream; times ahead of as_of count as now."""
    rate = F.lit(p.default)
    for name, value in p.per_hour.items():
        rate = F.when(stream == name, F.lit(value)).otherwise(rate)
    start = F.when(is_priority == 1, F.lit(p.priority_start)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(p.floor), start * F.exp(-rate * F.greatest(hours, F.lit(0.0))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def z_confidence(z: Column, p: Anomaly = Anomaly()) -> Column:
    """Confidence of a z-score: a logistic curve from the one at z = 0 to the ceiling."""
    low = sigmoid(F.lit(-p.steepness * p.z))
    return F.round(F.least(F.lit(p.ceiling), low + (p.ceiling - low) * sigmoid(p.steepness * (z - p.z))), 3)


def decision(score: Column) -> Column:
    return F.when(score > 0.8, "CREATE").when(score > 0.6, "FLAG").otherwise("STORE")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)
