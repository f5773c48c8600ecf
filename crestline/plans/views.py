"""Geographic views over the star-schema tables, and the SQL that makes the same views.

Coordinates come from integer arithmetic, so both engines agree to the last bit. The area
grows with the tables and the density stays, so spatial joins grow in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOUTH, WEST, NORTH = 54.4325, 18.4525, 54.4825
LAT_STEP, LNG_STEP = 2.7e-4, 4.6e-4

SQL_VIEWS = {
    "track_points": """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  54.4325::DOUBLE + ((user_id * 37) % 400) * 1e-4 + ((event_id * 7919) % 97) * 1e-5 AS lat,
  18.4525::DOUBLE + ((user_id * 53) % 800) * 1e-4 + ((event_id * 104729) % 97) * 1e-5 AS lng,
  ((event_id * 31) % 61) * 0.5::DOUBLE AS z, ((event_id * 13) % 10) / 10.0::DOUBLE AS water_risk,
  CASE event_type WHEN 'view' THEN 'paved' WHEN 'click' THEN 'gravel' WHEN 'signup' THEN 'natural-trail' WHEN 'error' THEN 'steps' ELSE 'open-terrain' END AS surface,
  event_type <> 'purchase' AS mapped,
  CASE WHEN event_type IN ('view', 'click') THEN 'Way ' || (event_id % 7) END AS way_name,
  CASE user_id % 3 WHEN 0 THEN 'hiker' WHEN 1 THEN 'runner' ELSE 'mtb' END AS profile
FROM events""",
    "hops": """
SELECT user_id, seq, profile, surface, mapped, way_name, water_risk, a_lat, a_lng, b_lat, b_lng, dz, meters,
  dz / greatest(meters, 1.0::DOUBLE) AS grade
FROM (SELECT *, sqrt(pow((b_lng - a_lng) * (111132.0::DOUBLE * cos((a_lat + b_lat) / 2 * pi() / 180)), 2) + pow((b_lat - a_lat) * 111132.0::DOUBLE, 2)) AS meters
  FROM (SELECT user_id, seq, profile, surface, mapped, way_name, water_risk, lat AS a_lat, lng AS a_lng,
      lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng, lead(z) OVER w - z AS dz
    FROM track_points WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE b_lat IS NOT NULL)""",
    "ways": """
SELECT o_orderkey AS way_id,
  CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'road' ELSE 'path' END AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'footway' WHEN '2-HIGH' THEN 'residential' WHEN '3-MEDIUM' THEN 'track' WHEN '4-NOT SPECIFIED' THEN 'steps' ELSE 'path' END AS highway,
  CASE o_orderstatus WHEN 'P' THEN 'unpaved' WHEN 'F' THEN ' Fine_Gravel' END AS surface,
  CASE o_custkey % 5 WHEN 0 THEN 'grade1' WHEN 1 THEN 'grade2' WHEN 2 THEN 'grade5' END AS tracktype,
  CASE o_custkey % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'Private ' END AS foot,
  CASE o_custkey % 11 WHEN 0 THEN 'private' WHEN 1 THEN 'no' END AS access,
  CASE o_custkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'none' END AS sidewalk,
  CASE o_orderkey % 13 WHEN 0 THEN 'marked' END AS crossing,
  CASE o_orderkey % 17 WHEN 0 THEN 'no' END AS bridge,
  CASE o_orderkey % 17 WHEN 0 THEN '1' WHEN 1 THEN 'x' END AS layer,
  'Way ' || (o_orderkey % 97) AS name
FROM orders""",
    "vertices": """
SELECT way_id, pos, r, c, 54.4325::DOUBLE + r * 1e-4 AS lat, 18.4525::DOUBLE + c * 1.5e-4 AS lng FROM (
  SELECT l_orderkey AS way_id, row_number() OVER w AS pos,
    ((l_orderkey // 125) * 3 + sum(l_partkey % 5 - 2) OVER w)::BIGINT AS r, ((l_orderkey % 125) * 3 + sum(l_suppkey % 5 - 2) OVER w)::BIGINT AS c
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING))""",
    "segments": """
SELECT way_id, pos, r, c, lat AS a_lat, lng AS a_lng, r2, c2, b_lat, b_lng, vertices_in_way FROM (
  SELECT *, lead(r) OVER w AS r2, lead(c) OVER w AS c2, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng, count(*) OVER (PARTITION BY way_id) AS vertices_in_way
  FROM vertices WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE r2 IS NOT NULL""",
    "barriers": """
SELECT c_custkey AS barrier_id, 54.4325::DOUBLE + r * 1e-4 AS a_lat, 18.4525::DOUBLE + c * 1.5e-4 AS a_lng, 54.4325::DOUBLE + (r + 3) * 1e-4 AS b_lat, 18.4525::DOUBLE + (c + 2) * 1.5e-4 AS b_lng
FROM (SELECT c_custkey, ((c_custkey * 10) // 125) * 3 AS r, ((c_custkey * 10) % 125) * 3 AS c FROM customer)""",
    "openings": """
SELECT s_suppkey AS opening_id, 54.4325::DOUBLE + (((s_suppkey * 150) // 125) * 3 + 1) * 1e-4 AS lat, 18.4525::DOUBLE + (((s_suppkey * 150) % 125) * 3 + 1) * 1.5e-4 AS lng FROM supplier""",
    "origins": """
SELECT c_custkey AS request_id, 54.4325::DOUBLE + ((c_custkey * 10) // 125) * 3e-4 + (c_custkey % 7) * 1e-5 AS lat, 18.4525::DOUBLE + ((c_custkey * 10) % 125) * 4.5e-4 + (c_custkey % 11) * 1e-5 AS lng,
  CASE c_custkey % 3 WHEN 0 THEN 'hiker' WHEN 1 THEN 'runner' ELSE 'mtb' END AS profile, 5.0::DOUBLE + c_nationkey * 3 AS max_grade_percent,
  1.0::DOUBLE + (c_custkey % 9) / 2.0 AS off_trail_aversion, 25.0::DOUBLE + (c_custkey % 40) * 25 AS max_off_trail_meters, c_custkey % 2 = 0 AS avoid_water, c_custkey % 4 = 0 AS street_walking
FROM customer""",
    "dem": "SELECT p_partkey // 20 AS r, p_partkey % 20 AS c, p_size::DOUBLE AS z FROM part",
    "water_lines": """
SELECT s_suppkey AS line_id, 54.4825::DOUBLE - r * 2.7e-4 AS a_lat, 18.4525::DOUBLE + c * 4.6e-4 AS a_lng, 54.4825::DOUBLE - (r + 1) * 2.7e-4 AS b_lat, 18.4525::DOUBLE + (c + 2) * 4.6e-4 AS b_lng
FROM (SELECT s_suppkey, s_suppkey AS r, (s_suppkey * 7) % 18 AS c FROM supplier)""",
}


def with_views(names: str, query: str) -> str:
    """query under the named views, in order."""
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names.split()) + "\n" + query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(c, values: dict, other=None):
    found = F
    for k, v in values.items():
        found = found.when(c == k, v)
    return found if other is None else found.otherwise(other)


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"),
        (F.lit(SOUTH) + (u * 37 % 400) * 1e-4 + (e * 7919 % 97) * 1e-5).alias("lat"),
        (F.lit(WEST) + (u * 53 % 800) * 1e-4 + (e * 104729 % 97) * 1e-5).alias("lng"),
        ((e * 31 % 61) * 0.5).alias("z"),
        ((e * 13 % 10) / 10.0).alias("water_risk"),
        _case(kind, {"view": "paved", "click": "gravel", "signup": "natural-trail", "error": "steps"}, "open-terrain").alias("surface"),
        (kind != "purchase").alias("mapped"),
        F.when(kind.isin("view", "click"), F.concat(F.lit("Way "), (e % 7).cast("string"))).alias("way_name"),
        _case(u % 3, {0: "hiker", 1: "runner"}, "mtb").alias("profile"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority, customer, key = F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("way_id"),
        F.when(priority.isin("2-HIGH", "3-MEDIUM"), "road").otherwise("path").alias("category"),
        _case(priority, {"1-URGENT": "footway", "2-HIGH": "residential", "3-MEDIUM": "track", "4-NOT SPECIFIED": "steps"}, "path").alias("highway"),
        _case(F.col("o_orderstatus"), {"P": "unpaved", "F": " Fine_Gravel"}).alias("surface"),
        _case(customer % 5, {0: "grade1", 1: "grade2", 2: "grade5"}).alias("tracktype"),
        _case(customer % 7, {0: "no", 1: "yes", 2: "Private "}).alias("foot"),
        _case(customer % 11, {0: "private", 1: "no"}).alias("access"),
        _case(customer % 3, {0: "both", 1: "none"}).alias("sidewalk"),
        _case(key % 13, {0: "marked"}).alias("crossing"),
        _case(key % 17, {0: "no"}).alias("bridge"),
        _case(key % 17, {0: "1", 1: "x"}).alias("layer"),
        F.concat(F.lit("Way "), (key % 97).cast("string")).alias("name"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("way_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    key = F.col("way_id")
    walked = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "way_id").select(  # renamed before the window, so that what follows by way is not shuffled again
        key,
        F.row_number().over(w).alias("pos"),
        (F.floor(key / 125) * 3 + F.sum(F.col("l_partkey") % 5 - 2).over(w)).alias("r"),
        (key % 125 * 3 + F.sum(F.col("l_suppkey") % 5 - 2).over(w)).alias("c"),
    )
    return walked.select("*", (F.lit(SOUTH) + F.col("r") * 1e-4).alias("lat"), (F.lit(WEST) + F.col("c") * 1.5e-4).alias("lng"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("way_id").orderBy("pos")
    ahead = vertices(spark, sf_dir).select(
        "way_id", "pos", "r", "c", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"),
        *(F.lead(x).over(w).alias(y) for x, y in (("r", "r2"), ("c", "c2"), ("lat", "b_lat"), ("lng", "b_lng"))),
        F.count("*").over(Window.partitionBy("way_id")).alias("vertices_in_way"),
    )
    return ahead.where("r2 IS NOT NULL")


def _lattice(r, c):
    return F.lit(SOUTH) + r * 1e-4, F.lit(WEST) + c * 1.5e-4


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    r, c = F.floor(key * 10 / 125) * 3, key * 10 % 125 * 3
    (a_lat, a_lng), (b_lat, b_lng) = _lattice(r, c), _lattice(r + 3, c + 2)
    return table(spark, sf_dir, "customer").select(key.alias("barrier_id"), a_lat.alias("a_lat"), a_lng.alias("a_lng"), b_lat.alias("b_lat"), b_lng.alias("b_lng"))


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    lat, lng = _lattice(F.floor(key * 150 / 125) * 3 + 1, key * 150 % 125 * 3 + 1)
    return table(spark, sf_dir, "supplier").select(key.alias("opening_id"), lat.alias("lat"), lng.alias("lng"))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        (F.lit(SOUTH) + F.floor(key * 10 / 125) * 3e-4 + key % 7 * 1e-5).alias("lat"),
        (F.lit(WEST) + key * 10 % 125 * 4.5e-4 + key % 11 * 1e-5).alias("lng"),
        _case(key % 3, {0: "hiker", 1: "runner"}, "mtb").alias("profile"),
        (5.0 + F.col("c_nationkey") * 3).alias("max_grade_percent"),
        (1.0 + key % 9 / 2.0).alias("off_trail_aversion"),
        (25.0 + key % 40 * 25).alias("max_off_trail_meters"),
        (key % 2 == 0).alias("avoid_water"),
        (key % 4 == 0).alias("street_walking"),
    )


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(key / 20).alias("r"), (key % 20).alias("c"), F.col("p_size").cast("double").alias("z"))


def water_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    r, c = key, key * 7 % 18
    return table(spark, sf_dir, "supplier").select(
        key.alias("line_id"), (F.lit(NORTH) - r * LAT_STEP).alias("a_lat"), (F.lit(WEST) + c * LNG_STEP).alias("a_lng"),
        (F.lit(NORTH) - (r + 1) * LAT_STEP).alias("b_lat"), (F.lit(WEST) + (c + 2) * LNG_STEP).alias("b_lng"),
    )
