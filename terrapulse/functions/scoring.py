"""Scalar criteria, scores and class thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the three-class zoning on a 0..100 score.
CLASS_HIGH = 66.0
CLASS_LOW = 33.0
# Siting thresholds and weights.
AXIS_MAX = 20.0
BONUS = 5.0
TOTAL_MAX = 100.0
LAND_FREE_MIN_M2 = 50.0
LAND_REF_M2 = 400.0
INSTALL_MIN_M2 = 4.0
INSTALL_REF_M2 = 40.0
SETBACK_M = 5.0
BUILT_MAX_M = 15.0
ROAD_ACCESS_M = 30.0
FIBRE_OK = ("Déployé", "Raccordable")
POWER_MIN_KVA = 36.0
POWER_COMFORT_KVA = 72.0
MONUMENT_RING_M = 500.0
BONUS_RADIUS_M = {"pv": 250.0, "borne_ve": 250.0, "poste": 300.0}
PREMIUM_MIN = 90.0
GOOD_MIN = 70.0
# Thresholds of the multi-axis commune analysis.
GRID_MAX_M = 150.0
COMMUNE_PREMIUM_MIN = 80.0
COMMUNE_GOOD_MIN = 60.0


def clip01(value: Column) -> Column:
    """Clip to 0..1 and keep NULL (least/greatest alone would turn NULL into a bound)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def rescale(value: Column, lo: float, hi: float, invert: bool = False) -> Column:
    scaled = clip01((value - F.lit(float(lo))) / F.lit(float(hi) - float(lo)))
    return F.lit(1.0) - scaled if invert else scaled


def band(value: Column, lo: float, hi: float, ramp: float) -> Column:
    """1 inside [lo, hi], linear ramps of width ``ramp`` on both sides."""
    rising = rescale(value, lo - ramp, lo)
    falling = rescale(value, hi, hi + ramp, invert=True)
    return F.when(value.isNotNull(), F.least(rising, falling))


def aptitude(criteria: Sequence[tuple[Column, float]], excluded: Column | None = None) -> Column:
    """Weighted mean of 0..1 criteria on a 0..100 scale; excluded rows score 0."""
    total = float(sum(weight for _, weight in criteria))
    if total <= 0:
        raise ValueError("the weights must sum to a positive number")
    weighted = reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in criteria])
    score = weighted / F.lit(total) * F.lit(100.0)
    return score if excluded is None else F.when(excluded, F.lit(0.0)).otherwise(score)


def three_classes(score: Column, high: float = CLASS_HIGH, low: float = CLASS_LOW) -> Column:
    return F.when(score >= high, 2).when(score >= low, 1).otherwise(0)


def priority_score(axes: Sequence[Column]) -> Column:
    """Geometric mean of the axes, each clipped to 0..1, times 100."""
    if not axes:
        raise ValueError("at least one axis is required")
    product = reduce(lambda a, b: a * b, [clip01(axis) for axis in axes])
    return F.pow(product, F.lit(1.0 / len(axes))) * F.lit(100.0)


def degradation(mean_slope: Column, scale: float = 0.01) -> Column:
    return F.coalesce(clip01(-mean_slope / F.lit(float(scale))), F.lit(0.0))


def land_score(free_m2: Column) -> Column:
    return F.least(free_m2 / F.lit(LAND_REF_M2) * F.lit(AXIS_MAX), F.lit(AXIS_MAX))


def land_gate(n_residential: Column, n_block: Column, free_m2: Column) -> Column:
    return (n_residential > 0) & (n_block == 0) & (free_m2 > LAND_FREE_MIN_M2)


def nuisance_score(install_m2: Column, built_m: Column, road_m: Column) -> Column:
    space = F.lit(8.0) * F.least(install_m2 / F.lit(INSTALL_REF_M2), F.lit(1.0))
    cable = F.when(built_m <= BUILT_MAX_M, F.lit(8.0)).otherwise(F.lit(0.0))
    road = F.when(road_m <= ROAD_ACCESS_M, F.lit(4.0)).otherwise(F.lit(0.0))
    return F.least(space + cable + road, F.lit(AXIS_MAX))


def nuisance_gate(install_m2: Column, built_m: Column) -> Column:
    return (install_m2 >= INSTALL_MIN_M2) & (built_m <= BUILT_MAX_M)


def fibre_score(status: Column) -> Column:
    return (
        F.when(status == "Déployé", F.lit(AXIS_MAX))
        .when(status == "Raccordable", F.lit(12.0))
        .otherwise(F.lit(0.0))
    )


def fibre_gate(status: Column) -> Column:
    return status.isin(*FIBRE_OK)


def energy_score(kva: Column) -> Column:
    share = (kva - F.lit(POWER_MIN_KVA)) / F.lit(POWER_COMFORT_KVA - POWER_MIN_KVA)
    return F.least(F.lit(10.0) + F.lit(10.0) * F.least(share, F.lit(1.0)), F.lit(AXIS_MAX))


def energy_gate(kva: Column) -> Column:
    return kva >= POWER_MIN_KVA


def total_score(parts: Sequence[Column]) -> Column:
    """Stored total: rounded to 0.1 first, then capped."""
    return F.least(F.round(reduce(lambda a, b: a + b, parts), 1), F.lit(TOTAL_MAX))


def total_class(parts: Sequence[Column]) -> Column:
    """Commercial class on the total *before* rounding."""
    raw = F.least(reduce(lambda a, b: a + b, parts), F.lit(TOTAL_MAX))
    return F.when(raw >= PREMIUM_MIN, "Premium").when(raw >= GOOD_MIN, "Bon").otherwise("Moyen")


def risk_band(score: Column) -> Column:
    return (
        F.when(score.between(0, 19), "low")
        .when(score.between(20, 50), "medium")
        .when(score.between(51, 100), "high")
    )


def occupation_status(n_establishments: Column) -> Column:
    return F.when(n_establishments == 0, "VACANT_CANDIDAT").otherwise("OCCUPE")
