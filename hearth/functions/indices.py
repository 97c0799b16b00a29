"""Index and score formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, col_, nonzero, round_half_even, round_half_up

# ---------------------------------------------------------------------------
# Fixed values of the scoring methodology.
# ---------------------------------------------------------------------------
VALUE_SCORE_WEIGHTS = {
    "affordability_score": 0.25,
    "safety_index": 0.20,
    "education_index": 0.20,
    "air_quality_index": 0.15,
    "natural_amenity_score": 0.12,
    "tier_bonus": 0.08,
}
TIER_BONUS = {"Hidden gem": 100.0, "Great value": 80.0, "Fair market": 60.0,
              "Premium": 30.0, "Overpriced": 0.0}
# Population classes (lower bounds) and the occupancy multiplier.
DENSITY_CLASSES = (("urban", 8000.0), ("suburban", 2500.0), ("small_town", 800.0))
PERSONS_PER_OCCUPIED_UNIT = 2.1
# Affordability: PTI at or above this ratio scores 0.
AFFORDABILITY_PTI_CAP = 20.0
MISSING_COMPONENT = 50.0
# ---------------------------------------------------------------------------


def pct(part, whole, digits: int = 1) -> Column:
    """``round(part / whole * 100, digits)`` (pandas rounding)."""
    return round_half_even(F.try_divide(col_(part), col_(whole)) * 100.0, digits)


def minmax_0_100(c, lo, hi, digits: int = 1) -> Column:
    """Min-max scaling to 0-100; a zero range gives NULL, not an error."""
    c = col_(c)
    return round_half_even(F.try_divide(c - col_(lo), col_(hi) - col_(lo)) * 100.0, digits)


def p95_clip_score(c, p95, digits: int = 1) -> Column:
    """``round(clip(x, 0, p95) / p95 * 100, digits)``."""
    return round_half_even(F.try_divide(clip(c, 0.0, col_(p95)), col_(p95)) * 100.0, digits)


def rate_per_100k(count, population, digits: int = 1) -> Column:
    return round_half_even(col_(count) / nonzero(population) * 100000.0, digits)


def safety_index(violent_rate, property_rate, p95_violent, p95_property) -> Column:
    v = F.try_divide(clip(violent_rate, 0.0, col_(p95_violent)), col_(p95_violent)) * 60.0
    p = F.try_divide(clip(property_rate, 0.0, col_(p95_property)), col_(p95_property)) * 40.0
    return clip(round_half_even(100.0 - (v + p), 1), 0.0, 100.0)


def air_quality_index(median_aqi, p95_aqi) -> Column:
    s = F.try_divide(clip(median_aqi, 0.0, col_(p95_aqi)), col_(p95_aqi)) * 100.0
    return clip(round_half_even(100.0 - s, 1), 0.0, 100.0)


def natural_amenity_score(rank) -> Column:
    return round_half_even((col_(rank) - 1.0) / 6.0 * 100.0, 1)


def education_index(academic_score, schools_normalized) -> Column:
    return round_half_even(
        F.coalesce(col_(academic_score), F.lit(MISSING_COMPONENT)) * 0.70
        + F.coalesce(col_(schools_normalized), F.lit(MISSING_COMPONENT)) * 0.30, 1)


def price_to_income(value, income) -> Column:
    return F.try_divide(col_(value), F.nullif(col_(income), F.lit(0.0)))


def total_population(occupied_units) -> Column:
    return col_(occupied_units) * PERSONS_PER_OCCUPIED_UNIT


def density_class(population) -> Column:
    p = col_(population)
    out = None
    for name, lower in DENSITY_CLASSES:
        out = F.when(p >= lower, name) if out is None else out.when(p >= lower, name)
    return out.when(p.isNotNull(), "rural")


def affordability_score(pti) -> Column:
    pti = col_(pti)
    capped = F.least(pti, F.lit(AFFORDABILITY_PTI_CAP))
    return F.when(pti.isNotNull(),
                  round_half_up(100.0 - capped / AFFORDABILITY_PTI_CAP * 100.0, 1))


def value_tier(pti, education) -> Column:
    """First applicable tier; order matters. No PTI -> 'Unknown'."""
    pti, edu = col_(pti), col_(education)
    return (F.when(pti.isNull(), "Unknown")
            .when((pti < 3) & (edu >= 55), "Hidden gem")
            .when((pti < 5) & (edu >= 45), "Great value")
            .when(pti < 8, "Fair market")
            .when(pti < 12, "Premium")
            .otherwise("Overpriced"))


def tier_bonus(tier) -> Column:
    t = col_(tier)
    out = None
    for name, bonus in TIER_BONUS.items():
        out = F.when(t == name, bonus) if out is None else out.when(t == name, bonus)
    return out


def value_score(affordability, safety, education, air, amenity, tier) -> Column:
    parts = [affordability, safety, education, air, amenity, tier_bonus(tier)]
    weights = list(VALUE_SCORE_WEIGHTS.values())
    total = None
    for part, w in zip(parts, weights):
        term = F.coalesce(col_(part), F.lit(MISSING_COMPONENT)) * w
        total = term if total is None else total + term
    return round_half_up(total, 1)
