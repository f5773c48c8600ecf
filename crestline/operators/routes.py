"""Rollups of routes: a route is a group of ordered hops with their measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions import costs, geo


def hops(points: DataFrame, route: str = "user_id", order: str = "seq") -> DataFrame:
    """Consecutive points as hops a -> b with meters, dz and net grade (over at least one metre); attributes are those of a."""
    w = Window.partitionBy(route).orderBy(order)
    ahead = points.select("*", F.lead("lat").over(w).alias("b_lat"), F.lead("lng").over(w).alias("b_lng"), (F.lead("z").over(w) - F.col("z")).alias("dz"))
    named = ahead.where("b_lat IS NOT NULL").withColumnsRenamed({"lat": "a_lat", "lng": "a_lng"}).drop("z")
    return named.withColumn("meters", geo.distance(geo.at("a"), geo.at("b"))).withColumn("grade", F.col("dz") / F.greatest("meters", F.lit(1.0)))


def timed(rows: DataFrame, profile: str = "profile") -> DataFrame:
    return rows.withColumn("minutes", F.col("meters") / costs.meters_per_minute(F.col(profile), F.col("grade"), F.col("surface")))


def strands(rows: DataFrame, route: str = "user_id", order: str = "seq") -> DataFrame:
    """rows with strand: runs of equal `mapped`, numbered from 1."""
    w = Window.partitionBy(route).orderBy(order)
    starts = F.coalesce((F.col("mapped") != F.lag("mapped").over(w)).cast("int"), F.lit(1))
    return rows.withColumn("strand", F.sum(starts).over(w))


def summary(rows: DataFrame, route: str = "user_id", has_elevation: bool = True) -> DataFrame:
    """One row per route: distance, climb, steepest net grade, time, mapped, water and off-trail distance, mapped share and confidence."""
    total = lambda c: F.sum(c)
    when = lambda condition: F.sum(F.when(condition, F.col("meters")).otherwise(0.0))
    rolled = timed(rows).groupBy(route).agg(
        total("meters").alias("distance_m"),
        total(F.greatest("dz", F.lit(0.0))).alias("ascent_m"),
        total(F.greatest(-F.col("dz"), F.lit(0.0))).alias("descent_m"),
        F.max(F.abs("grade")).alias("max_grade"),
        total("minutes").alias("minutes"),
        when(F.col("mapped")).alias("mapped_m"),
        when(F.col("water_risk") > 0.4).alias("water_m"),
    )
    whole = F.greatest("distance_m", F.lit(1.0))
    return rolled.select(
        "*",
        F.greatest(F.col("distance_m") - F.col("mapped_m"), F.lit(0.0)).alias("off_trail_m"),
        (F.col("mapped_m") / whole).alias("mapped_share"),
        costs.confidence(F.col("mapped_m"), F.col("water_m"), F.col("distance_m"), F.lit(has_elevation)).alias("confidence"),
    )


def longest_off_trail(rows: DataFrame, route: str = "user_id", order: str = "seq") -> DataFrame:
    runs = strands(rows, route, order).groupBy(route, "strand").agg(F.sum("meters").alias("run_m"), F.first("mapped").alias("on"))
    return runs.groupBy(route).agg(F.coalesce(F.max(F.when(~F.col("on"), F.col("run_m"))), F.lit(0.0)).alias("longest_off_trail_m"))


def surfaces(rows: DataFrame, route: str = "user_id") -> DataFrame:
    return rows.groupBy(route, "surface").agg(F.sum("meters").alias("meters"))


def way_names(rows: DataFrame, route: str = "user_id", order: str = "seq") -> DataFrame:
    """The distinct names of a route in the order in which they come, joined by ", "."""
    first = rows.where("way_name IS NOT NULL").groupBy(route, "way_name").agg(F.min(order).alias("first_seq"))
    listed = F.array_sort(F.collect_list(F.struct("first_seq", "way_name")))
    return first.groupBy(route).agg(F.array_join(F.transform(listed, lambda s: s["way_name"]), ", ").alias("way_names"))


def elevation_profile(points: DataFrame, route: str = "user_id", order: str = "seq") -> DataFrame:
    """Cumulative distance and height at each point, from 0 at the first."""
    w = Window.partitionBy(route).orderBy(order)
    step = geo.distance(geo.Point(F.lag("lat").over(w), F.lag("lng").over(w)), geo.Point(F.col("lat"), F.col("lng")))
    stepped = points.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return stepped.select(route, order, F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_m"), "z")


def signature(distance: Column, points: Column) -> Column:
    """Rounded length, number of points and about twelve of them; equal signatures are the same route."""
    from crestline.functions.numeric import fixed, js_round

    n = F.size(points)
    every = F.greatest(F.lit(1), F.floor(n / 12).cast("int"))
    sampled = F.transform(F.filter(F.transform(points, lambda p, i: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), i.alias("i"))), lambda p: p["i"] % every == 0), lambda p: F.concat_ws(",", fixed(p["lat"], 6), fixed(p["lng"], 6)))
    return F.concat_ws("|", js_round(distance).cast("string"), n.cast("string"), F.array_join(sampled, "|"))


def distinct_alternatives(routes: DataFrame, request: str = "request_id", order: str = "flavor_index") -> DataFrame:
    """Of a request's routes with one signature, the first stays."""
    w = Window.partitionBy(request, "signature").orderBy(order)
    return routes.withColumn("again", F.row_number().over(w)).where("again = 1").drop("again")
