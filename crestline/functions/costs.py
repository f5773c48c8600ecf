"""Travel speed and cost as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp

# Flat speed in km/h, and the share of it that each surface allows.
FLAT_SPEED_KMH = {"hiker": 4.6, "runner": 7.6, "mtb": 12.0}
SURFACE_SPEED = {
    "paved": {"hiker": 1.0, "runner": 1.05, "mtb": 1.2},
    "gravel": {"hiker": 0.97, "runner": 0.95, "mtb": 1.0},
    "natural-trail": {"hiker": 0.92, "runner": 0.84, "mtb": 0.78},
    "steps": {"hiker": 0.42, "runner": 0.34, "mtb": 0.14},
    "open-terrain": {"hiker": 0.58, "runner": 0.44, "mtb": 0.3},
}
FLAVORS = ("balanced", "direct", "mapped")
CRITICAL_GRADE = 1 / 3.5
GRADE_LIMITS = {"hiker": (5.0, 60.0), "runner": (5.0, 45.0), "mtb": (5.0, 25.0)}
FLAT = math.exp(-3.5 * 0.05)


def lookup(key: Column, values: dict) -> Column:
    found = None
    for k, v in values.items():
        found = F.when(key == k, v) if found is None else found.when(key == k, v)
    return found


def grade_speed_factor(grade: Column) -> Column:
    """Tobler's curve, 1 on the flat."""
    return F.exp(-3.5 * F.abs(grade + 0.05)) / FLAT


def meters_per_minute(profile: Column, grade: Column, surface: Column) -> Column:
    share = lookup(surface, {s: lookup(profile, by) for s, by in SURFACE_SPEED.items()})
    return F.greatest(F.lit(6.0), lookup(profile, FLAT_SPEED_KMH) * grade_speed_factor(grade) * share * 1000 / 60)


def max_grade(percent: Column) -> Column:
    return F.greatest(F.lit(0.02), percent / 100)


def clamp_grade_limit(profile: Column, percent: Column) -> Column:
    low, high = (lookup(profile, {p: r[k] for p, r in GRADE_LIMITS.items()}) for k in (0, 1))
    return clamp(percent, low, high)


def aversion(flavor: Column, off_trail_aversion: Column) -> Column:
    return F.when(flavor == "mapped", F.greatest(off_trail_aversion, F.lit(3.2))).when(flavor == "direct", 1.0).otherwise(off_trail_aversion)


def off_trail_budget(flavor: Column, meters: Column) -> Column:
    return F.when(flavor == "direct", F.greatest(meters, F.lit(900.0))).otherwise(meters)


def profile_allowed(steepest: Column, percent: Column, water_risk: Column, avoid_water: Column, bridge_or_tunnel: Column) -> Column:
    return (steepest <= max_grade(percent) + 0.005) & ~(avoid_water & (water_risk > 0.55) & ~bridge_or_tunnel)


def edge_allowed(profile: Column, surface: Column, is_street: Column, walkway: Column, allow_street: Column, crosses_street: Column, allow_crossing: Column, near_crossing: Column) -> Column:
    """A street needs a walkway or leave to walk on it, a bicycle takes no steps, and a street is crossed with leave or near a mapped crossing."""
    return (~is_street | walkway | allow_street) & ~((surface == "steps") & (profile == "mtb")) & (~crosses_street | allow_crossing | near_crossing)


def connector_step_cost(minutes: Column, dislike: Column, side_slope: Column, water_risk: Column, avoid_water: Column) -> Column:
    """Off-trail minutes, dearer on side slopes and near water."""
    water = F.when(avoid_water, 8.0).otherwise(1.5)
    return minutes * dislike * (1 + clamp(side_slope / 60, F.lit(0.0), F.lit(0.6))) * (1 + water_risk * water)


def edge_cost(allowed: Column, minutes: Column, water_risk: Column, avoid_water: Column) -> Column:
    """Null where the edge is not allowed."""
    return F.when(allowed, F.greatest(F.lit(0.001), minutes * (1 + water_risk * F.when(avoid_water, 6.0).otherwise(1.2))))


def confidence(mapped: Column, water: Column, total: Column, has_elevation: Column) -> Column:
    whole = F.greatest(total, F.lit(1.0))
    return clamp(0.55 + mapped / whole * 0.4 - water / whole * 0.2 + F.when(has_elevation, 0.05).otherwise(-0.15), F.lit(0.3), F.lit(0.96))
