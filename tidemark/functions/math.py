"""Arithmetic that follows the research rules: halves round up, missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go towards plus infinity on the binary value."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    """x within low..high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def percent_change(now: Column, base: Column) -> Column:
    """(now - base) / base * 100; null where base is 0 or missing."""
    return F.when(base != 0, (now - base) / base * 100)


def tier_weight(tier: Column) -> Column:
    """Weight of a corroborating source by tier."""
    return F.when(tier == 0, 1.0).when(tier == 1, 0.85).when(tier == 2, 0.4).otherwise(0.0)


def issuer_weight(tier: Column) -> Column:
    """Weight of an issuer in a weighted issuer count by its best tier."""
    return F.when(tier == 0, 1.0).when(tier == 1, 0.75).when(tier == 2, 0.25).otherwise(0.0)


def lag_weight(days: Column) -> Column:
    """1 up to a week from the claim, falling to 0.3 at 180 days."""
    away = F.abs(days)
    return F.when(away <= 7, 1.0).otherwise(round_half_up(F.greatest(F.lit(0.3), 1 - (away - 7) / 173.0 * 0.7)))


def spread_percent(bid: Column, ask: Column) -> Column:
    """Bid-ask spread as percent of the middle; null without both sides."""
    return F.when((bid > 0) & (ask > 0), (ask - bid) / ((bid + ask) / 2) * 100)
