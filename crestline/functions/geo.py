"""Geodesy as Column expressions. A point is a pair of columns (lat, lng) in degrees; lengths are metres."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp

METERS_PER_DEGREE_LATITUDE = 111_132.0


class Point(NamedTuple):
    lat: Column
    lng: Column


class Planar(NamedTuple):
    x: Column
    y: Column


class Box(NamedTuple):
    north: Column
    south: Column
    east: Column
    west: Column


def at(prefix: str) -> Point:
    """The point in columns <prefix>_lat and <prefix>_lng."""
    return Point(F.col(f"{prefix}_lat"), F.col(f"{prefix}_lng"))


def fixed_point(lat: float, lng: float) -> Point:
    return Point(F.lit(lat), F.lit(lng))


def radians(degrees: Column) -> Column:
    return degrees * math.pi / 180


def meters_per_degree_longitude(latitude: Column) -> Column:
    return METERS_PER_DEGREE_LATITUDE * F.cos(radians(latitude))


def distance(a: Point, b: Point) -> Column:
    """Equirectangular at the mean latitude."""
    x = (b.lng - a.lng) * meters_per_degree_longitude((a.lat + b.lat) / 2)
    y = (b.lat - a.lat) * METERS_PER_DEGREE_LATITUDE
    return F.sqrt(x * x + y * y)


def interpolate(a: Point, b: Point, fraction: Column) -> Point:
    return Point(a.lat + (b.lat - a.lat) * fraction, a.lng + (b.lng - a.lng) * fraction)


def center(box: Box) -> Point:
    return Point((box.north + box.south) / 2, (box.east + box.west) / 2)


def contains(box: Box, p: Point) -> Column:
    return (p.lat >= box.south) & (p.lat <= box.north) & (p.lng >= box.west) & (p.lng <= box.east)


def pad(box: Box, meters: Column) -> Box:
    lat = meters / METERS_PER_DEGREE_LATITUDE
    lng = meters / meters_per_degree_longitude(center(box).lat)
    return Box(box.north + lat, box.south - lat, box.east + lng, box.west - lng)


def planar(p: Point, latitude: Column) -> Planar:
    return Planar(p.lng * meters_per_degree_longitude(latitude), p.lat * METERS_PER_DEGREE_LATITUDE)


def cross(a: Planar, b: Planar, c: Planar) -> Column:
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def distance_to_segment(p: Point, a: Point, b: Point) -> Column:
    latitude = (p.lat + a.lat + b.lat) / 3
    q, s, e = planar(p, latitude), planar(a, latitude), planar(b, latitude)
    dx, dy = e.x - s.x, e.y - s.y
    squared = dx * dx + dy * dy
    along = F.when(squared == 0, 0.0).otherwise(clamp(((q.x - s.x) * dx + (q.y - s.y) * dy) / F.nullif(squared, F.lit(0.0)), F.lit(0.0), F.lit(1.0)))
    return F.hypot(q.x - (s.x + along * dx), q.y - (s.y + along * dy))


def on_segment(p: Point, a: Point, b: Point) -> Column:
    """Within 0.02 square metres of cross product and 0.1 m of the segment's box."""
    latitude = (p.lat + a.lat + b.lat) / 3
    q, s, e = planar(p, latitude), planar(a, latitude), planar(b, latitude)
    near = F.abs(cross(s, e, q)) < 0.02
    return near & q.x.between(F.least(s.x, e.x) - 0.1, F.greatest(s.x, e.x) + 0.1) & q.y.between(F.least(s.y, e.y) - 0.1, F.greatest(s.y, e.y) + 0.1)


def _four(a: Point, b: Point, c: Point, d: Point) -> list[Planar]:
    latitude = (a.lat + b.lat + c.lat + d.lat) / 4
    return [planar(p, latitude) for p in (a, b, c, d)]


def let(values: dict[str, Column], body) -> Column:
    """body(names bound to values): each value is computed once, however often body names it."""
    bound = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.element_at(F.transform(bound, body), 1)


def intersection(a: Point, b: Point, c: Point, d: Point) -> Column:
    """struct(lat, lng) where a-b meets c-d, else null. Parallel segments meet at the first shared end in the order a, b, c, d."""

    def meet(v: Column) -> Column:
        ends = [Point(v[f"{n}_lat"], v[f"{n}_lng"]) for n in "abcd"]
        p, q, r, s = (Planar(v[f"{n}_x"], v[f"{n}_y"]) for n in "abcd")
        denominator = (p.x - q.x) * (r.y - s.y) - (p.y - q.y) * (r.x - s.x)
        safe = F.when(F.abs(denominator) >= 1e-5, denominator)
        first = ((p.x - r.x) * (r.y - s.y) - (p.y - r.y) * (r.x - s.x)) / safe
        second = ((p.x - r.x) * (p.y - q.y) - (p.y - r.y) * (p.x - q.x)) / safe
        met = interpolate(ends[0], ends[1], first)
        inside = first.between(-1e-5, 1.00001) & second.between(-1e-5, 1.00001)
        shared = F.coalesce(*(F.when(on_segment(e, *ends[:2]) & on_segment(e, *ends[2:]), F.struct(e.lat.alias("lat"), e.lng.alias("lng"))) for e in ends))
        return F.when(safe.isNull(), shared).when(inside, F.struct(met.lat.alias("lat"), met.lng.alias("lng")))

    flat = _four(a, b, c, d)
    values = {f"{n}_{k}": getattr(p, k) for n, p in zip("abcd", (a, b, c, d), strict=True) for k in ("lat", "lng")}
    return let(values | {f"{n}_{k}": getattr(p, k) for n, p in zip("abcd", flat, strict=True) for k in ("x", "y")}, meet)


def parallel(a: Point, b: Point, c: Point, d: Point, tolerance: float = 0.42) -> Column:
    p, q, r, s = _four(a, b, c, d)
    one, two = F.hypot(q.x - p.x, q.y - p.y), F.hypot(s.x - r.x, s.y - r.y)
    sine = F.abs((q.x - p.x) * (s.y - r.y) - (q.y - p.y) * (s.x - r.x)) / F.nullif(one * two, F.lit(0.0))
    return (one >= 1) & (two >= 1) & F.coalesce(sine < tolerance, F.lit(False))


def tile_x(lng: Column, zoom: int) -> Column:
    """Web map tile column, with its fraction."""
    return (lng + 180) / 360 * float(2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    phi = radians(lat)
    return (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * float(2**zoom)


def tile_url(template: str, zoom: int, x: Column, y: Column) -> Column:
    head, tail = template.replace("{z}", str(zoom)).split("{x}")
    between, end = tail.split("{y}")
    return F.concat(F.lit(head), x.cast("string"), F.lit(between), y.cast("string"), F.lit(end))


def terrarium_height(red: Column, green: Column, blue: Column) -> Column:
    return red * 256.0 + green + blue / 256.0 - 32768.0


def to_poland_1992(p: Point) -> Column:
    """struct(x, y): EPSG:2180, a transverse Mercator on GRS80 (central meridian 19, scale 0.9993), by the series in the third flattening."""
    flattening = 1 / 298.257222101
    n = flattening / (2 - flattening)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    eccentric = 2 * math.sqrt(n) / (1 + n)
    phi, lam = radians(p.lat), radians(p.lng - 19.0)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(phi)) - eccentric * atanh(eccentric * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, alpha in enumerate(alphas, start=1):
        east = east + alpha * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + alpha * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((500_000.0 + 0.9993 * radius * east).alias("x"), (-5_300_000.0 + 0.9993 * radius * north).alias("y"))
