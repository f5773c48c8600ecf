"""Queries that search; their results are tested against brute force, as SQL cannot settle labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.operators import contours, itineraries, raster, search
from crestline.operators.checkpoints import ensure_checkpoint_dir

from .rasters import PLACE
from .views import NORTH, SOUTH, WEST, barriers, dem, openings, origins, segments, vertices, water_lines, ways, with_views


def contours_stitched(spark, d):
    lines = contours.contour_lines(dem(spark, d), 10.0, *PLACE, minimum=5, passes=2)
    return lines.select("elevation", "is_index", F.size("points").alias("n_points"), F.round(lines.points[0]["lat"], 6).alias("first_lat"), F.round(lines.points[0]["lng"], 6).alias("first_lng"))


def connector_paths(spark, d):
    """The cells that each origin reaches off the network, under its own profile, grade cap, aversion, budget and road and water rules, as a tree."""
    asked = origins(spark, d).select(
        F.col("request_id").cast("string").alias("leg_id"), F.lit("start").alias("end"), "lat", "lng", "profile", "max_grade_percent", F.col("off_trail_aversion").alias("aversion"), F.col("max_off_trail_meters").alias("budget"),
        (F.col("request_id") % 5 < 3).alias("allow_crossing"), F.col("street_walking").alias("allow_street"), "avoid_water",
    )
    found = itineraries.off_trail_reach(asked, _ground(spark, d))
    return found.select(F.col("leg_id").cast("long").alias("request_id"), "r", "c", F.round("cost", 4).alias("cost"), F.round("meters", 3).alias("meters"), "before_r", "before_c")


def _asked(spark, d):
    """A request for each opening, in one of the three modes, over the next two openings, with the settings of the origin of its number."""
    o = openings(spark, d)
    spot = F.struct("lat", "lng")
    after = [o.select((F.col("opening_id") - k).alias("opening_id"), spot.alias(f"p{k}")) for k in (1, 2)]
    own = origins(spark, d).drop("lat", "lng").withColumnRenamed("request_id", "opening_id")
    mode = F.element_at(F.array(*map(F.lit, ("nearest", "destination", "design"))), (F.col("opening_id") % 3 + 1).cast("int"))
    rows = o.join(after[0], "opening_id", "left").join(after[1], "opening_id", "left").join(own, "opening_id").withColumn("mode", mode)
    last = F.when(F.col("mode") == "design", F.coalesce("p2", "p1")).otherwise(F.col("p1"))
    shown = rows.select(
        F.col("opening_id").alias("request_id"), F.when(last.isNull(), "nearest").otherwise(F.col("mode")).alias("mode"), spot.alias("start"), last.alias("target"), F.when(F.col("p2").isNotNull(), F.array("p1")).alias("waypoints"), (F.col("opening_id") % 2 == 0).alias("show_alternatives"),
        "profile", "max_grade_percent", "off_trail_aversion", "max_off_trail_meters", (F.col("opening_id") % 5 < 3).alias("allow_crossing"), F.col("street_walking").alias("allow_street"), "avoid_water",
    )
    return itineraries.routing_requests(shown)


def _ground(spark, d):
    lines = water_lines(spark, d)
    size = raster.extent(dem(spark, d)).select("rows", "columns")
    risk = raster.water_risk(lines.crossJoin(F.broadcast(size)), F.col("rows"), F.col("columns"), *PLACE, 30.0)  # one row
    slopes = raster.horn_slope(dem(spark, d), 30.0, 30.0)
    ensure_checkpoint_dir(spark)
    return itineraries.Ground(dem(spark, d), PLACE, segments(spark, d), vertices(spark, d), ways(spark, d), barriers(spark, d), openings(spark, d), risk.checkpoint(), slopes.checkpoint())


def plan_route(spark, d):
    """Each request's distinct routes by flavour: off the network to an entry, over it, and off it again, leg by leg, under the request's own settings."""
    found = itineraries.plan(_asked(spark, d), _ground(spark, d))
    kept = found.select("request_id", "flavor", *(F.round(c, 3).alias(c) for c in ("distance_m", "ascent_m", "descent_m", "max_grade", "minutes", "mapped_m", "off_trail_m", "longest_off_trail_m", "water_m", "confidence")), "way_names", "signature")
    return kept.withColumn("points_in", F.size(F.split("signature", "\\|")) - 2)


def out_of_bounds(spark, d):
    box = geo.Box(*map(F.lit, (NORTH, SOUTH + 0.001, WEST + 0.05, WEST + 0.001)))
    return search.warnings(origins(spark, d), box).select("request_id", "outside", "warning")


QUERIES = {f.__name__: f for f in (contours_stitched, connector_paths, plan_route, out_of_bounds)}
SQL = {
    "out_of_bounds": with_views("origins", """SELECT request_id, 1 AS outside, '1 point sits outside the surveyed area; heights there are not measured.' AS warning FROM origins
  WHERE NOT (lat BETWEEN 54.4325::DOUBLE + 0.001::DOUBLE AND 54.4825::DOUBLE AND lng BETWEEN 18.4525::DOUBLE + 0.001::DOUBLE AND 18.4525::DOUBLE + 0.05::DOUBLE)"""),
}
