"""Queries for export, link state and saved routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crestline.functions import text
from crestline.functions.numeric import js_round, number_or
from crestline.operators import raster, routes

from .rasters import PLACE, js
from .rasters import SQL as RASTER_SQL
from .tracks import ROLLUP
from .views import dem, origins, table, track_points, with_views

CREATOR, PREFIX = "crestline", "Route"


def _exported(spark, d):
    points = track_points(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "z"))).alias("points"))
    names = routes.way_names(routes.hops(track_points(spark, d)))
    rows = points.join(names, "user_id", "left")
    return rows.withColumn("name", text.route_name(F.split(F.coalesce("way_names", F.lit("")), ", ", -1), PREFIX)).withColumn("name", F.when(F.col("way_names").isNull(), PREFIX).otherwise(F.col("name")))


def gpx_export(spark, d):
    return _exported(spark, d).select("user_id", F.md5(text.gpx(F.concat("name", F.lit(' & "co"')), F.col("points"), F.col("user_id") % 2 == 0, CREATOR)).alias("md5"))


def geojson_export(spark, d):
    summary = routes.summary(routes.hops(track_points(spark, d)))
    rows = _exported(spark, d).join(summary, "user_id")
    properties = {
        "name": F.col("name"), "distanceMeters": js_round(F.round("distance_m", 6)), "ascentMeters": js_round(F.round("ascent_m", 6)),
        "mappedShare": text.share(F.round("mapped_m", 6), F.round("distance_m", 6)), "elevationSource": F.when(F.col("user_id") % 2 == 0, "elevation-tiles").otherwise("none"),
    }
    feature = text.geojson(properties, F.col("points"), F.col("user_id") % 2 == 0)
    parsed = F.from_json(feature, "type string, properties struct<name string, distanceMeters long, ascentMeters long, mappedShare long, elevationSource string>, geometry struct<type string, coordinates array<array<double>>>")
    return rows.select("user_id", parsed.alias("f")).select("user_id", "f.type", "f.properties.*", F.size("f.geometry.coordinates").alias("n"), F.round(F.element_at("f.geometry.coordinates", 1)[0], 6).alias("first_lng"), F.size(F.element_at("f.geometry.coordinates", 1)).alias("width"))


def exported(points, heights, name, form):
    """user_id, text, media_type: each user's route as GPX or GeoJSON, as the column form says; heights (user_id, seq, z) were sampled for the export."""
    listed = points.join(heights, ["user_id", "seq"], "left").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "z"))).alias("points"))
    measured = F.exists("points", lambda p: p["z"].isNotNull())
    properties = {"name": name, "elevationSource": F.when(measured, "elevation-tiles").otherwise("none")}
    written, media = text.export_route(form, text.gpx(name, F.col("points"), measured, CREATOR), text.geojson(properties, F.col("points"), measured))
    return listed.select("user_id", written.alias("text"), media.alias("media_type"))


def route_export(spark, d):
    """Routes in the form asked for, with heights from the raster; what the written text holds is counted."""
    points = track_points(spark, d).select("user_id", "seq", "lat", "lng")
    heights = raster.sample(points, dem(spark, d), ["user_id", "seq"], *PLACE)
    form = F.when(F.col("user_id") % 3 == 0, "geojson").otherwise("gpx")
    found = exported(points, heights, F.concat(F.lit("Track "), F.col("user_id").cast("string")), form)
    is_gpx = F.col("media_type") == "application/gpx+xml"
    coordinates = F.from_json("text", "geometry struct<coordinates array<array<double>>>")["geometry"]["coordinates"]
    times = lambda pattern: F.regexp_count("text", F.lit(pattern))
    n_points = F.when(is_gpx, times("<trkpt ")).otherwise(F.size(coordinates))
    n_heights = F.when(is_gpx, times("<ele>")).otherwise(F.size(F.filter(coordinates, lambda c: F.size(c) == 3)))
    return found.select("user_id", "media_type", n_points.cast("long").alias("n_points"), n_heights.cast("long").alias("n_heights"))


def url_state_roundtrip(spark, d):
    o = origins(spark, d)
    state = text.write_state({"m": F.lit("nearest"), "p": F.col("profile"), "s": text.encode_point(F.col("lat"), F.col("lng")), "g": F.when(F.col("avoid_water"), F.col("max_grade_percent").cast("int").cast("string")).otherwise(F.lit("steep")), "xc": F.when(F.col("street_walking"), "1").otherwise("0")})
    parsed = o.select("request_id", text.read_state(F.concat(F.lit("#"), state)).alias("m"))
    p = text.decode_point(text.state_field(F.col("m"), "s"))
    return parsed.select("request_id", text.state_field(F.col("m"), "p").alias("profile"), p["lat"].alias("lat"), p["lng"].alias("lng"), number_or(text.state_field(F.col("m"), "g"), F.lit(35.0)).alias("grade"), number_or(text.state_field(F.col("m"), "e"), F.lit(2.0)).alias("aversion"), (text.state_field(F.col("m"), "xc") == "1").alias("crossing"))


def saved_routes_top30(spark, d):
    """Each user's 30 newest events as saved routes."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place <= 30").select("user_id", "place", "event_id")


def saved_routes_parsed(spark, d):
    """The saved payloads; what does not parse counts as absent."""
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(0)).alias("k"))


def formatted(spark, d):
    s = routes.summary(routes.hops(track_points(spark, d)))
    meters, minutes = F.round("distance_m", 4), F.round("minutes", 4)
    return s.select("user_id", text.format_distance(meters, 1).alias("distance"), text.format_duration(minutes).alias("duration"), text.nice_scale(meters).alias("scale"), text.share(F.round("mapped_m", 4), meters).alias("mapped_percent"))


def route_labels(spark, d):
    o = origins(spark, d)
    return o.select("request_id", text.format_coordinate(F.col("lat"), F.col("lng")).alias("place"), text.grade_color(F.col("max_grade_percent") / 250).alias("color"), text.format_saved_at(F.col("request_id") * 98_765_432).alias("saved_at"))


QUERIES = {f.__name__: f for f in (gpx_export, geojson_export, route_export, url_state_roundtrip, saved_routes_top30, saved_routes_parsed, formatted, route_labels)}

NAMES = "SELECT user_id, coalesce('Route via ' || array_to_string(list_slice(list(way_name ORDER BY f), 1, 2), ' and '), 'Route') AS name FROM (SELECT user_id, way_name, min(seq) AS f FROM hops WHERE way_name IS NOT NULL GROUP BY ALL) GROUP BY user_id"
SQL = {
    "route_labels": with_views("origins", """SELECT request_id, printf('%.5f, %.5f', lat, lng) AS place,
  CASE WHEN max_grade_percent / 250 < 0.05 THEN '#5b93d6' WHEN max_grade_percent / 250 < 0.12 THEN '#4e9b74' WHEN max_grade_percent / 250 < 0.2 THEN '#c8973f' ELSE '#c4693f' END AS color,
  strftime(epoch_ms(request_id * 98765432), '%-d %b, %H:%M') AS saved_at FROM origins"""),
    "gpx_export": with_views("track_points hops", f"""SELECT user_id, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="crestline" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '  <metadata><name>' || n || '</name></metadata>' || chr(10) || '  <trk>' || chr(10) || '    <name>' || n || '</name>' || chr(10) || '    <trkseg>' || chr(10)
  || string_agg('      <trkpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lng) || '">' || CASE WHEN user_id % 2 = 0 THEN '<ele>' || printf('%.1f', z) || '</ele>' ELSE '' END || '</trkpt>', chr(10) ORDER BY seq) || chr(10) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' || chr(10)) AS md5
  FROM track_points JOIN (SELECT p.user_id, coalesce(name, 'Route') || ' &amp; &quot;co&quot;' AS n FROM (SELECT DISTINCT user_id FROM track_points) p LEFT JOIN ({NAMES}) m ON p.user_id = m.user_id) USING (user_id) GROUP BY user_id, n"""),
    "geojson_export": with_views("track_points hops", f"""SELECT r.user_id, 'Feature' AS type, coalesce(name, 'Route') AS name, {js('round(distance_m, 6)')}::BIGINT AS distanceMeters, {js('round(ascent_m, 6)')}::BIGINT AS ascentMeters, {js('round(mapped_m, 6) / greatest(round(distance_m, 6), 1) * 100')}::BIGINT AS mappedShare,
  CASE WHEN r.user_id % 2 = 0 THEN 'elevation-tiles' ELSE 'none' END AS elevationSource, n, first_lng, CASE WHEN r.user_id % 2 = 0 THEN 3 ELSE 2 END AS width
  FROM ({ROLLUP}) r JOIN (SELECT user_id, count(*) AS n, round(arg_min(lng, seq), 6) AS first_lng FROM track_points GROUP BY user_id) p ON p.user_id = r.user_id LEFT JOIN ({NAMES}) m ON m.user_id = r.user_id"""),
    "url_state_roundtrip": with_views("origins", "SELECT request_id, profile, printf('%.5f', lat)::DOUBLE AS lat, printf('%.5f', lng)::DOUBLE AS lng, CASE WHEN avoid_water THEN max_grade_percent ELSE 35 END AS grade, 0.0::DOUBLE AS aversion, street_walking AS crossing FROM origins"),
    "saved_routes_top30": "SELECT user_id, place, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 30",
    "saved_routes_parsed": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events",
    "formatted": with_views("track_points hops", f"""SELECT user_id, CASE WHEN m >= 1000 THEN printf('%.1f', m / 1000) || ' km' ELSE {js('m')}::BIGINT || ' m' END AS distance, CASE WHEN t < 60 THEN t || ' min' ELSE (t // 60) || ' h ' || (t % 60) || ' min' END AS duration,
  (SELECT arg_min(k * p, (abs(k * p - m), k * p)) FROM (VALUES (1.0::DOUBLE), (2.0), (5.0), (10.0)) v(k)) AS scale, {js('mm / greatest(m, 1) * 100')}::BIGINT AS mapped_percent
  FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(m))) AS p FROM (SELECT user_id, round(distance_m, 4) AS m, round(mapped_m, 4) AS mm, {js('round(minutes, 4)')}::BIGINT AS t FROM ({ROLLUP})))"""),
}
SQL["route_export"] = f"""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'application/geo+json' ELSE 'application/gpx+xml' END AS media_type, count(*) AS n_points, count(z) AS n_heights FROM ({RASTER_SQL['bilinear_sample']}) GROUP BY user_id"""
