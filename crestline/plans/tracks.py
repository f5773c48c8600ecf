"""Queries over the tracks that events make."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.functions import costs, geo, numeric
from crestline.operators import routes

from .views import track_points, with_views

SPEED = """greatest(6.0::DOUBLE, (CASE profile WHEN 'hiker' THEN 4.6::DOUBLE WHEN 'runner' THEN 7.6::DOUBLE ELSE 12.0::DOUBLE END)
 * (exp(-3.5::DOUBLE * abs(grade + 0.05::DOUBLE)) / exp(-3.5::DOUBLE * 0.05::DOUBLE))
 * (CASE surface || ' ' || profile WHEN 'paved hiker' THEN 1.0 WHEN 'paved runner' THEN 1.05 WHEN 'paved mtb' THEN 1.2
  WHEN 'gravel hiker' THEN 0.97 WHEN 'gravel runner' THEN 0.95 WHEN 'gravel mtb' THEN 1.0
  WHEN 'natural-trail hiker' THEN 0.92 WHEN 'natural-trail runner' THEN 0.84 WHEN 'natural-trail mtb' THEN 0.78
  WHEN 'steps hiker' THEN 0.42 WHEN 'steps runner' THEN 0.34 WHEN 'steps mtb' THEN 0.14
  WHEN 'open-terrain hiker' THEN 0.58 WHEN 'open-terrain runner' THEN 0.44 ELSE 0.3 END)::DOUBLE * 1000 / 60)"""


def r(name: str, places: int = 4):
    return F.round(name, places).alias(name)


def _hops(spark, d):
    return routes.hops(track_points(spark, d))


def track_summary(spark, d):
    s = routes.summary(_hops(spark, d))
    return s.select("user_id", *(r(c) for c in s.columns[1:]))


def segment_distance(spark, d):
    return _hops(spark, d).select("user_id", "seq", r("meters"), r("grade", 6))


def tobler_speed(spark, d):
    rows = _hops(spark, d)
    return rows.select("user_id", "seq", F.round(costs.grade_speed_factor(F.col("grade")), 6).alias("factor"), F.round(costs.meters_per_minute(F.col("profile"), F.col("grade"), F.col("surface")), 4).alias("m_per_min"))


def travel_time_by_profile(spark, d):
    each = _hops(spark, d).withColumn("profile", F.explode(F.array(*map(F.lit, costs.FLAT_SPEED_KMH))))
    return routes.timed(each).groupBy("user_id", "profile").agg(F.round(F.sum("minutes"), 4).alias("minutes"))


def ascent_descent(spark, d):
    return routes.summary(_hops(spark, d)).select("user_id", r("ascent_m"), r("descent_m"), r("max_grade", 6))


def surface_breakdown(spark, d):
    return routes.surfaces(_hops(spark, d)).select("user_id", "surface", r("meters")).orderBy("user_id", F.desc("meters"))


def longest_offtrail_run(spark, d):
    return routes.longest_off_trail(_hops(spark, d)).select("user_id", r("longest_off_trail_m"))


def elevation_profile(spark, d):
    return routes.elevation_profile(track_points(spark, d)).select("user_id", "seq", r("cumulative_m"), "z")


def profile_range(spark, d):
    span = track_points(spark, d).groupBy("user_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return span.select("user_id", "low", (F.col("low") + F.greatest(F.lit(12.0), F.col("high") - F.col("low"))).alias("high"))


def route_strands(spark, d):
    rows = routes.strands(_hops(spark, d)).groupBy("user_id", "strand").agg(F.first("mapped").alias("mapped"), F.count("*").alias("n_hops"), F.sum("meters").alias("meters"))
    return rows.select("user_id", "strand", "mapped", "n_hops", r("meters"))


def way_names_first_seen(spark, d):
    return routes.way_names(_hops(spark, d))


def confidence_score(spark, d):
    return routes.summary(_hops(spark, d), has_elevation=False).select("user_id", r("mapped_share", 6), r("confidence", 6))


def route_bbox(spark, d):
    return track_points(spark, d).groupBy("user_id").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lng")))


def nearest_sample(spark, d):
    """The sample nearest to the middle of each track's length."""
    rows = routes.elevation_profile(track_points(spark, d))
    half = rows.groupBy("user_id").agg((F.max("cumulative_m") / 2).alias("middle"))
    gap = F.round(F.abs(F.col("cumulative_m") - F.col("middle")), 4)
    return rows.join(half, "user_id").groupBy("user_id").agg(F.min_by("seq", F.struct(gap, F.col("seq"))).alias("seq"), F.min(gap).alias("gap_m"))


def alternatives_dedupe(spark, d):
    """Three flavours of each track, one of which repeats another's points."""
    points = track_points(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("points"))
    flavored = points.select("user_id", F.posexplode(F.array(*map(F.lit, costs.FLAVORS))).alias("flavor_index", "flavor"), "points")
    drawn = flavored.withColumn("points", F.when(F.col("flavor") == "mapped", F.reverse("points")).otherwise(F.col("points")))
    distance = F.size("points") * 10.0
    return routes.distinct_alternatives(drawn.withColumn("signature", routes.signature(distance, F.col("points"))), "user_id").select("user_id", "flavor_index", "flavor", F.size("points").alias("n_points"))


def pairs_of_hops(spark, d):
    """Each hop with the hop after next of its track."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("seq")
    rows = _hops(spark, d).select("user_id", "seq", "a_lat", "a_lng", "b_lat", "b_lng", *(F.lead(c, 2).over(w).alias(f"{x}_{y}") for c, x, y in (("a_lat", "c", "lat"), ("a_lng", "c", "lng"), ("b_lat", "d", "lat"), ("b_lng", "d", "lng"))))
    return rows.where("c_lat IS NOT NULL")


def point_segment_distance(spark, d):
    return pairs_of_hops(spark, d).select("user_id", "seq", F.round(geo.distance_to_segment(geo.at("c"), geo.at("a"), geo.at("b")), 4).alias("meters"))


def segment_intersection(spark, d):
    met = pairs_of_hops(spark, d).select("user_id", "seq", geo.intersection(*map(geo.at, "abcd")).alias("p"))
    return met.where("p IS NOT NULL").select("user_id", "seq", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


def segments_parallel(spark, d):
    return pairs_of_hops(spark, d).select("user_id", "seq", geo.parallel(*map(geo.at, "abcd")).alias("is_parallel"))


def interpolated_points(spark, d):
    rows = _hops(spark, d).withColumn("fraction", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0)))))
    p = geo.interpolate(geo.at("a"), geo.at("b"), F.col("fraction"))
    return rows.select("user_id", "seq", "fraction", F.round(p.lat, 9).alias("lat"), F.round(p.lng, 9).alias("lng"))



def bounds_contain(spark, d):
    box = geo.Box(*map(F.lit, (54.46, 54.44, 18.5, 18.46)))
    points = track_points(spark, d)
    return points.groupBy("user_id").agg(F.count_if(geo.contains(box, geo.Point(F.col("lat"), F.col("lng")))).alias("inside"), F.count_if(~geo.contains(box, geo.Point(F.col("lat"), F.col("lng")))).alias("outside"))


def pad_bounds(spark, d):
    boxes = track_points(spark, d).groupBy("user_id").agg(F.max("lat").alias("n"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.min("lng").alias("w"))
    box = geo.pad(geo.Box(*map(F.col, "nsew")), F.lit(150.0))
    mid = geo.center(geo.Box(*map(F.col, "nsew")))
    return boxes.select("user_id", *(F.round(c, 8).alias(k) for k, c in box._asdict().items()), F.round(mid.lat, 8).alias("mid_lat"), F.round(mid.lng, 8).alias("mid_lng"))


def tile_xy(spark, d):
    return track_points(spark, d).select("user_id", "seq", F.round(geo.tile_x(F.col("lng"), 13), 6).alias("x"), F.round(geo.tile_y(F.col("lat"), 13), 6).alias("y"))


def node_identity(spark, d):
    return track_points(spark, d).groupBy(numeric.micro_degrees(F.col("lat")).alias("lat_e6"), numeric.micro_degrees(F.col("lng")).alias("lng_e6")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (track_summary, segment_distance, tobler_speed, travel_time_by_profile, ascent_descent, surface_breakdown, longest_offtrail_run, elevation_profile, profile_range, route_strands, way_names_first_seen, confidence_score, route_bbox, nearest_sample, alternatives_dedupe, point_segment_distance, segment_intersection, segments_parallel, interpolated_points, bounds_contain, pad_bounds, tile_xy, node_identity)}

ROLLUP = f"""
SELECT user_id, sum(meters) AS distance_m, sum(greatest(dz, 0)) AS ascent_m, sum(greatest(-dz, 0)) AS descent_m, max(abs(grade)) AS max_grade,
  sum(meters / {SPEED}) AS minutes, sum(CASE WHEN mapped THEN meters ELSE 0 END) AS mapped_m, sum(CASE WHEN water_risk > 0.4 THEN meters ELSE 0 END) AS water_m
FROM hops GROUP BY user_id"""
STRANDS = """
SELECT *, sum(CASE WHEN mapped IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS strand
FROM (SELECT *, lag(mapped) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM hops)"""
PROFILE = """
SELECT user_id, seq, z, sum(step) OVER (PARTITION BY user_id ORDER BY seq) AS cumulative_m FROM (
  SELECT user_id, seq, z, coalesce(sqrt(pow((lng - lag(lng) OVER w) * (111132.0::DOUBLE * cos((lag(lat) OVER w + lat) / 2 * pi() / 180)), 2) + pow((lat - lag(lat) OVER w) * 111132.0::DOUBLE, 2)), 0.0::DOUBLE) AS step
  FROM track_points WINDOW w AS (PARTITION BY user_id ORDER BY seq))"""
FOUR = """
SELECT *, (a_lat + b_lat + c_lat + d_lat) / 4 AS ref FROM (
  SELECT user_id, seq, a_lat, a_lng, b_lat, b_lng, lead(a_lat, 2) OVER w AS c_lat, lead(a_lng, 2) OVER w AS c_lng, lead(b_lat, 2) OVER w AS d_lat, lead(b_lng, 2) OVER w AS d_lng
  FROM hops WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE c_lat IS NOT NULL"""
PLANAR = """
SELECT *, """ + ", ".join(f"{p}_lng * (111132.0::DOUBLE * cos(ref * pi() / 180)) AS {p}_x, {p}_lat * 111132.0::DOUBLE AS {p}_y" for p in "abcd") + " FROM four"


def _on(p: str, a: str, b: str) -> str:
    ref = f"(({p}_lat + {a}_lat + {b}_lat) / 3)"
    x = lambda q: f"({q}_lng * (111132.0::DOUBLE * cos({ref} * pi() / 180)))"
    y = lambda q: f"({q}_lat * 111132.0::DOUBLE)"
    return f"(abs(({x(b)} - {x(a)}) * ({y(p)} - {y(a)}) - ({y(b)} - {y(a)}) * ({x(p)} - {x(a)})) < 0.02 AND {x(p)} BETWEEN least({x(a)}, {x(b)}) - 0.1 AND greatest({x(a)}, {x(b)}) + 0.1 AND {y(p)} BETWEEN least({y(a)}, {y(b)}) - 0.1 AND greatest({y(a)}, {y(b)}) + 0.1)"


SHARED = {k: "CASE " + " ".join(f"WHEN {_on(p, 'a', 'b')} AND {_on(p, 'c', 'd')} THEN {p}_{k}" for p in "abcd") + " END" for k in ("lat", "lng")}
MET = f"""
SELECT user_id, seq, CASE WHEN abs(den) < 1e-5 THEN {SHARED['lat']} WHEN t BETWEEN -1e-5 AND 1.00001 AND u BETWEEN -1e-5 AND 1.00001 THEN a_lat + (b_lat - a_lat) * t END AS lat,
  CASE WHEN abs(den) < 1e-5 THEN {SHARED['lng']} WHEN t BETWEEN -1e-5 AND 1.00001 AND u BETWEEN -1e-5 AND 1.00001 THEN a_lng + (b_lng - a_lng) * t END AS lng
FROM (SELECT *, ((a_x - c_x) * (c_y - d_y) - (a_y - c_y) * (c_x - d_x)) / nullif(den, 0) AS t, ((a_x - c_x) * (a_y - b_y) - (a_y - c_y) * (a_x - b_x)) / nullif(den, 0) AS u
  FROM (SELECT *, (a_x - b_x) * (c_y - d_y) - (a_y - b_y) * (c_x - d_x) AS den FROM planar))"""


def q(select: str, views: str = "track_points hops") -> str:
    return with_views(views, select)


SQL = {
    "track_summary": q(f"""SELECT user_id, round(distance_m, 4) AS distance_m, round(ascent_m, 4) AS ascent_m, round(descent_m, 4) AS descent_m, round(max_grade, 4) AS max_grade,
  round(minutes, 4) AS minutes, round(mapped_m, 4) AS mapped_m, round(water_m, 4) AS water_m, round(greatest(distance_m - mapped_m, 0), 4) AS off_trail_m,
  round(mapped_m / greatest(distance_m, 1), 4) AS mapped_share,
  round(least(0.96::DOUBLE, greatest(0.3::DOUBLE, 0.55 + mapped_m / greatest(distance_m, 1) * 0.4 - water_m / greatest(distance_m, 1) * 0.2 + 0.05)), 4) AS confidence FROM ({ROLLUP})"""),
    "segment_distance": q("SELECT user_id, seq, round(meters, 4) AS meters, round(grade, 6) AS grade FROM hops"),
    "tobler_speed": q(f"SELECT user_id, seq, round(exp(-3.5::DOUBLE * abs(grade + 0.05)) / exp(-3.5::DOUBLE * 0.05), 6) AS factor, round({SPEED}, 4) AS m_per_min FROM hops"),
    "travel_time_by_profile": q(f"SELECT user_id, profile, round(sum(meters / {SPEED}), 4) AS minutes FROM (SELECT * EXCLUDE (profile) FROM hops) CROSS JOIN (VALUES ('hiker'), ('runner'), ('mtb')) p(profile) GROUP BY ALL"),
    "ascent_descent": q(f"SELECT user_id, round(ascent_m, 4) AS ascent_m, round(descent_m, 4) AS descent_m, round(max_grade, 6) AS max_grade FROM ({ROLLUP})"),
    "surface_breakdown": q("SELECT user_id, surface, round(sum(meters), 4) AS meters FROM hops GROUP BY ALL"),
    "longest_offtrail_run": q(f"SELECT user_id, round(coalesce(max(CASE WHEN NOT mapped THEN m END), 0), 4) AS longest_off_trail_m FROM (SELECT user_id, strand, mapped, sum(meters) AS m FROM ({STRANDS}) GROUP BY ALL) GROUP BY user_id"),
    "elevation_profile": q(f"SELECT user_id, seq, round(cumulative_m, 4) AS cumulative_m, z FROM ({PROFILE})", "track_points"),
    "profile_range": q("SELECT user_id, min(z) AS low, min(z) + greatest(12.0::DOUBLE, max(z) - min(z)) AS high FROM track_points GROUP BY user_id", "track_points"),
    "route_strands": q(f"SELECT user_id, strand, mapped, count(*) AS n_hops, round(sum(meters), 4) AS meters FROM ({STRANDS}) GROUP BY user_id, strand, mapped"),
    "way_names_first_seen": q("SELECT user_id, string_agg(way_name, ', ' ORDER BY f) AS way_names FROM (SELECT user_id, way_name, min(seq) AS f FROM hops WHERE way_name IS NOT NULL GROUP BY ALL) GROUP BY user_id"),
    "confidence_score": q(f"SELECT user_id, round(mapped_m / greatest(distance_m, 1), 6) AS mapped_share, round(least(0.96::DOUBLE, greatest(0.3::DOUBLE, 0.55 + mapped_m / greatest(distance_m, 1) * 0.4 - water_m / greatest(distance_m, 1) * 0.2 - 0.15)), 6) AS confidence FROM ({ROLLUP})"),
    "route_bbox": q("SELECT user_id, min(lat) AS min_lat, min(lng) AS min_lng, max(lat) AS max_lat, max(lng) AS max_lng FROM track_points GROUP BY user_id", "track_points"),
    "nearest_sample": q(f"""SELECT user_id, arg_min(seq, (g, seq)) AS seq, min(g) AS gap_m FROM (SELECT user_id, seq, round(abs(cumulative_m - max(cumulative_m) OVER (PARTITION BY user_id) / 2), 4) AS g FROM ({PROFILE})) GROUP BY user_id""", "track_points"),
    "alternatives_dedupe": q("""SELECT user_id, i AS flavor_index, f AS flavor, n AS n_points FROM (SELECT user_id, count(*) AS n FROM track_points GROUP BY user_id) CROSS JOIN (VALUES (0, 'balanced'), (2, 'mapped')) v(i, f) WHERE n > 1 OR i = 0""", "track_points"),
    "point_segment_distance": with_views("track_points hops", """SELECT user_id, seq, round(sqrt(pow(px - (ax + t * dx), 2) + pow(py - (ay + t * dy), 2)), 4) AS meters FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) END AS t FROM (
  SELECT user_id, seq, c_lng * k AS px, c_lat * 111132.0::DOUBLE AS py, a_lng * k AS ax, a_lat * 111132.0::DOUBLE AS ay, b_lng * k - a_lng * k AS dx, b_lat * 111132.0::DOUBLE - a_lat * 111132.0::DOUBLE AS dy
  FROM (SELECT *, 111132.0::DOUBLE * cos((c_lat + a_lat + b_lat) / 3 * pi() / 180) AS k FROM (""" + FOUR + "))))"),
    "segment_intersection": with_views("track_points hops", "").strip() + f", four AS ({FOUR}), planar AS ({PLANAR}) SELECT user_id, seq, round(lat, 6) AS lat, round(lng, 6) AS lng FROM ({MET}) WHERE lat IS NOT NULL",
    "segments_parallel": with_views("track_points hops", "").strip() + f""", four AS ({FOUR}), planar AS ({PLANAR}) SELECT user_id, seq,
  l1 >= 1 AND l2 >= 1 AND coalesce(abs((b_x - a_x) * (d_y - c_y) - (b_y - a_y) * (d_x - c_x)) / nullif(l1 * l2, 0) < 0.42, false) AS is_parallel
  FROM (SELECT *, sqrt(pow(b_x - a_x, 2) + pow(b_y - a_y, 2)) AS l1, sqrt(pow(d_x - c_x, 2) + pow(d_y - c_y, 2)) AS l2 FROM planar)""",
    "interpolated_points": q("SELECT user_id, seq, f AS fraction, round(a_lat + (b_lat - a_lat) * f, 9) AS lat, round(a_lng + (b_lng - a_lng) * f, 9) AS lng FROM hops CROSS JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(f)"),
    "bounds_contain": q("SELECT user_id, count(*) FILTER (i) AS inside, count(*) FILTER (NOT i) AS outside FROM (SELECT user_id, lat BETWEEN 54.44 AND 54.46 AND lng BETWEEN 18.46 AND 18.5 AS i FROM track_points) GROUP BY user_id", "track_points"),
    "pad_bounds": q("""SELECT user_id, round(n + 150 / 111132.0::DOUBLE, 8) AS north, round(s - 150 / 111132.0::DOUBLE, 8) AS south, round(e + p, 8) AS east, round(w - p, 8) AS west, round((n + s) / 2, 8) AS mid_lat, round((e + w) / 2, 8) AS mid_lng
  FROM (SELECT *, 150 / (111132.0::DOUBLE * cos((n + s) / 2 * pi() / 180)) AS p FROM (SELECT user_id, max(lat) AS n, min(lat) AS s, max(lng) AS e, min(lng) AS w FROM track_points GROUP BY user_id))""", "track_points"),
    "tile_xy": q("SELECT user_id, seq, round((lng + 180) / 360 * 8192, 6) AS x, round((1 - ln(tan(lat * pi() / 180) + 1 / cos(lat * pi() / 180)) / pi()) / 2 * 8192, 6) AS y FROM track_points", "track_points"),
    "node_identity": q("SELECT (floor(lat * 1e6) + CASE WHEN lat * 1e6 - floor(lat * 1e6) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS lat_e6, (floor(lng * 1e6) + CASE WHEN lng * 1e6 - floor(lng * 1e6) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS lng_e6, count(*) AS n FROM track_points GROUP BY ALL", "track_points"),
}
