"""Meaning of way tags as Column expressions over a table of ways.

A way has category, highway, name, surface, access, foot, sidewalk, sidewalk_left,
sidewalk_right, crossing, bridge, tunnel, layer, tracktype and barrier, all strings or null.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag values that the rules know.
PATHS = ["path", "footway", "cycleway", "bridleway", "pedestrian", "steps"]
ROADS = ["primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "track"]
BLOCKING = ["fence", "wall", "retaining_wall", "hedge", "city_wall"]
OPENINGS = ["gate", "lift_gate", "swing_gate", "kissing_gate", "stile", "turnstile", "cattle_grid", "entrance"]
ALLOWED_ON_FOOT = ["yes", "designated", "permissive", "destination"]
PAVED = ["asphalt", "concrete", "paving_stones", "paved", "sett", "cobblestone", "metal", "wood"]
GRAVEL = ["gravel", "compacted", "fine_gravel", "pebblestone", "rock", "unpaved"]
SURFACES = ["paved", "gravel", "natural-trail", "steps", "open-terrain"]


def plain(c: Column) -> Column:
    """Trimmed and in lower case; null counts as empty."""
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def _is(c: Column, value: str) -> Column:
    return c.eqNullSafe(F.lit(value))


def category(highway: Column, waterway: Column, natural: Column, barrier: Column) -> Column:
    """path before road before water before barrier; null for anything else."""
    return (
        F.when(highway.isin(PATHS), "path")
        .when(highway.isin(ROADS), "road")
        .when((F.coalesce(waterway, F.lit("")) != "") | _is(natural, "water"), "water")
        .when(F.coalesce(barrier, F.lit("")) != "", "barrier")
    )


def blocks_on_foot(barrier: Column, foot: Column, access: Column) -> Column:
    closed = F.coalesce(barrier.isin(BLOCKING), F.lit(False))
    return closed & ~plain(foot).isin(ALLOWED_ON_FOOT) & ~plain(access).isin("yes", "permissive", "destination")


def is_opening(barrier: Column, access: Column, locked: Column) -> Column:
    return F.coalesce(barrier.isin(OPENINGS), F.lit(False)) & ~plain(access).isin("private", "no") & (plain(locked) != "yes")


def is_path(cat: Column, highway: Column) -> Column:
    return _is(cat, "path") | _is(highway, "track")


def is_street(cat: Column, highway: Column) -> Column:
    return _is(cat, "road") & ~_is(highway, "track")


def has_walkway(cat: Column, highway: Column, *sidewalks: Column) -> Column:
    return is_path(cat, highway) | reduce(or_, (plain(s).isin("yes", "both", "left", "right", "separate") for s in sidewalks))


def is_restricted(foot: Column, access: Column) -> Column:
    """An explicit foot tag wins over access."""
    return F.when(plain(foot).isin(ALLOWED_ON_FOOT), False).when(plain(foot).isin("no", "private"), True).otherwise(plain(access).isin("private", "no"))


def surface_class(cat: Column, highway: Column, surface: Column, tracktype: Column) -> Column:
    """Ordered substring tests: "unpaved" holds "paved" and therefore counts as paved."""
    s, t = plain(surface), plain(tracktype)
    holds = lambda values: reduce(or_, (s.contains(v) for v in values))
    return (
        F.when(_is(highway, "steps"), "steps")
        .when((s != "") & holds(PAVED), "paved")
        .when((s != "") & holds(GRAVEL), "gravel")
        .when(s != "", "natural-trail")
        .when(t == "grade1", "paved")
        .when(t.isin("grade2", "grade3"), "gravel")
        .when(t != "", "natural-trail")
        .when(_is(cat, "road"), "paved")
        .otherwise("natural-trail")
    )


def layer_number(layer: Column) -> Column:
    """0 where the tag is absent or not a finite number."""
    n = layer.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n).otherwise(0.0)


def is_tagged(c: Column) -> Column:
    """Any text counts, "no" too."""
    return plain(c) != ""


def is_bridge_or_tunnel(bridge: Column, tunnel: Column) -> Column:
    return is_tagged(bridge) | is_tagged(tunnel)
