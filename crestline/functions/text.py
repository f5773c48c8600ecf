"""Printed forms of routes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import fixed, js_round


def escape_xml(text: Column) -> Column:
    """& < > " in that order; ' stays."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def route_name(way_names: Column, prefix: str) -> Column:
    """prefix, via the first two way names if there are any."""
    return F.when(F.size(way_names) > 0, F.concat(F.lit(f"{prefix} via "), F.array_join(F.slice(way_names, 1, 2), " and "))).otherwise(prefix)


def gpx(name: Column, points: Column, has_elevation: Column, creator: str) -> Column:
    """points: array of (lat, lng, z). Heights are written only where they were measured."""
    point = lambda p: F.concat(F.lit('      <trkpt lat="'), fixed(p["lat"], 6), F.lit('" lon="'), fixed(p["lng"], 6), F.lit('">'), F.when(has_elevation & p["z"].isNotNull(), F.concat(F.lit("<ele>"), fixed(p["z"], 1), F.lit("</ele>"))).otherwise(""), F.lit("</trkpt>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata><name>'
    escaped = escape_xml(name)
    return F.concat(F.lit(head), escaped, F.lit("</name></metadata>\n  <trk>\n    <name>"), escaped, F.lit("</name>\n    <trkseg>\n"), F.array_join(F.transform(points, point), "\n"), F.lit("\n    </trkseg>\n  </trk>\n</gpx>\n"))


def geojson(properties: dict[str, Column], points: Column, has_elevation: Column) -> Column:
    """A LineString feature as one line of JSON; a coordinate is [lng, lat] or [lng, lat, height to a decimetre]."""
    pair = lambda p: F.when(has_elevation & p["z"].isNotNull(), F.array(p["lng"], p["lat"], F.round(p["z"], 1))).otherwise(F.array(p["lng"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(points, pair).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties"), geometry.alias("geometry")))


def export_route(format: Column, as_gpx: Column, as_geojson: Column) -> tuple[Column, Column]:
    """(text, media type)."""
    return F.when(format == "gpx", as_gpx).otherwise(as_geojson), F.when(format == "gpx", "application/gpx+xml").otherwise("application/geo+json")


def share(part: Column, whole: Column) -> Column:
    return js_round(part / F.greatest(whole, F.lit(1.0)) * 100)


def format_distance(meters: Column, places: int = 1) -> Column:
    return F.when(meters >= 1000, F.concat(fixed(meters / 1000, places), F.lit(" km"))).otherwise(F.concat(js_round(meters).cast("string"), F.lit(" m")))


def format_duration(minutes: Column) -> Column:
    whole = js_round(minutes)
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit(" h "), (whole % 60).cast("string"), F.lit(" min")))


def nice_scale(meters: Column) -> Column:
    """The nearest of 1, 2, 5 and 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(meters)))
    options = F.transform(F.array(*map(F.lit, (1.0, 2.0, 5.0, 10.0))), lambda k: F.struct(F.abs(k * power - meters).alias("gap"), (k * power).alias("size")))
    return F.array_min(options)["size"]


def encode_point(lat: Column, lng: Column) -> Column:
    return F.concat_ws(",", fixed(lat, 5), fixed(lng, 5))


def write_state(fields: dict[str, Column]) -> Column:
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(c)) for k, c in fields.items()))


def read_state(state: Column) -> Column:
    return F.str_to_map(F.regexp_replace(state, "^#", ""), F.lit("&"), F.lit("="))


def state_field(parsed: Column, key: str) -> Column:
    return F.url_decode(F.element_at(parsed, key))


def decode_point(text: Column) -> Column:
    """struct(lat, lng), null if either is not a number."""
    lat, lng = (F.split(text, ",")[k].try_cast("double") for k in (0, 1))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def format_coordinate(lat: Column, lng: Column) -> Column:
    return F.concat(fixed(lat, 5), F.lit(", "), fixed(lng, 5))


def grade_color(grade: Column) -> Column:
    """The colour of a stretch by its steepness. Fixed values."""
    steep = F.abs(grade)
    return F.when(steep < 0.05, "#5b93d6").when(steep < 0.12, "#4e9b74").when(steep < 0.2, "#c8973f").otherwise("#c4693f")


def format_saved_at(millis: Column) -> Column:
    """Day, short month, hour and minute, in the session's time zone."""
    return F.date_format(F.timestamp_millis(millis), "d MMM, HH:mm")
