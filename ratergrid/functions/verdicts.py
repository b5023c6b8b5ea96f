"""Labels for metric values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cuts used to label agreement, drift and divergence.
RELIABLE, TENTATIVE = 0.80, 0.67
STABLE, ACCEPTABLE = 0.80, 0.60
DRIFT_BAND = 0.01
FLOOR_SHARE = 0.90


def agreement_zone(value: Column, high: float = RELIABLE, low: float = TENTATIVE) -> Column:
    return (F.when(value.isNull(), "n/a").when(value >= high, "reliable")
            .when(value >= low, "tentative").otherwise("below"))


def stability_verdict(rho: Column, high: float = STABLE, low: float = ACCEPTABLE) -> Column:
    """Both cuts are exclusive; an undefined correlation is unstable."""
    return F.when(rho > high, "Stable").when(rho > low, "Acceptable").otherwise("Unstable")


def drift_direction(value: Column, band: float = 0.0) -> Column:
    """Sign of a drift; means within ``band`` of zero count as no change."""
    return (F.when(value > band, "positive").when(value < -band, "negative")
            .when(value.isNotNull(), "same"))


def divergence_bucket(diff: Column) -> Column:
    return F.when(diff == 0, "exact").when(F.abs(diff) <= 2, "near").when(diff.isNotNull(), "far")


def floor_effect_flag(share_at_minimum: Column, threshold: float = FLOOR_SHARE) -> Column:
    return share_at_minimum > threshold
