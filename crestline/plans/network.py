"""Queries over the way network that orders and lineitems make."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.functions import costs, geo, tags
from crestline.operators import network, raster

from .rasters import PLACE, js
from .views import barriers, dem, openings, origins, segments, vertices, ways, with_views


def r(name, places=4):
    return F.round(name, places).alias(name)


def surface_class(spark, d):
    return network.described(ways(spark, d)).select("way_id", "surface_class")


def access_restricted(spark, d):
    return network.described(ways(spark, d)).select("way_id", "restricted")


def walkway_evidence(spark, d):
    return network.described(ways(spark, d)).select("way_id", "is_path", "is_street", "walkway")


def way_flags(spark, d):
    return network.described(ways(spark, d)).select("way_id", "bridge_or_tunnel", "layer_number", "tagged_crossing")


def category_precedence(spark, d):
    w = ways(spark, d)
    tagged = w.select("way_id", F.when(F.col("highway") != "path", F.col("highway")).alias("hw"), F.when(F.col("category") == "road", "stream").alias("ww"), F.when(F.col("foot") == "no", "water").alias("nat"), F.when(F.col("access").isNotNull(), "fence").alias("bar"))
    return tagged.select("way_id", tags.category(F.col("hw"), F.col("ww"), F.col("nat"), F.col("bar")).alias("category"))


def blocks_on_foot(spark, d):
    w = ways(spark, d)
    barrier = F.when(F.col("highway") == "residential", "wall").when(F.col("highway") == "track", "hedge").otherwise("kerb")
    return w.select("way_id", tags.blocks_on_foot(barrier, F.col("foot"), F.col("access")).alias("blocks"), tags.is_opening(F.when(F.col("highway") == "steps", "gate"), F.col("access"), F.col("sidewalk")).alias("opening"))


def graph_nodes(spark, d):
    return network.nodes(vertices(spark, d), ways(spark, d)).select("lat_e6", "lng_e6", r("lat", 7), r("lng", 7), "path_evidence")


def _edges(spark, d):
    return network.edges(segments(spark, d), vertices(spark, d), ways(spark, d))


def graph_edges(spark, d):
    return _edges(spark, d).select("from_lat", "from_lng", "to_lat", "to_lng", "way_id", "pos", r("meters"), "surface_class", "walkway")


def interior_crossings(spark, d):
    return _edges(spark, d).where("crosses_street").select("way_id", "pos").distinct()


def graph_stats(spark, d):
    n = network.nodes(vertices(spark, d), ways(spark, d)).agg(F.count("*").alias("nodes"))
    counts = [_edges(spark, d).agg(F.count("*").alias("edges")), crossing_points(spark, d).withColumnRenamed("points", "crossings"), barriers(spark, d).agg(F.count("*").alias("barriers")), openings(spark, d).agg(F.count("*").alias("openings"))]
    for one in counts:
        n = n.crossJoin(one)  # one row each
    return n


def crossing_points(spark, d):
    return network.crossing_points(segments(spark, d), ways(spark, d)).agg(F.count("*").alias("points"))


def near_crossing_semi(spark, d):
    tagged = vertices(spark, d).join(ways(spark, d).where("crossing IS NOT NULL"), "way_id", "left_semi").select("lat", "lng").distinct()
    return network.near(origins(spark, d).select("request_id", "lat", "lng"), tagged, network.CROSSING_METERS).select("request_id")


def barrier_violation_anti(spark, d):
    return network.allowed_segments(segments(spark, d), barriers(spark, d), openings(spark, d)).select("way_id", "pos")


def nearest_nodes_topk(spark, d):
    return network.nearest_nodes(origins(spark, d), network.nodes(vertices(spark, d), ways(spark, d)), 24).select("request_id", "rank", "lat_e6", "lng_e6", r("meters"))


def segment_profile(spark, d):
    return network.segment_profile(segments(spark, d), ["way_id", "pos"], dem(spark, d), PLACE).select("way_id", "pos", *((F.round(c, 4) + 0.0).alias(c) for c in ("distance_m", "change_m", "ascent_m", "descent_m", "max_grade", "minutes")))


def edge_cost(spark, d):
    """Edges as a hiker who keeps off streets and out of water sees them; water risk by way."""
    rows = _edges(spark, d).withColumns({"risk": F.col("way_id") % 10 / 10.0, "grade": (F.col("pos") % 7 - 3) / 10.0})
    minutes = F.col("meters") / costs.meters_per_minute(F.lit("hiker"), F.col("grade"), F.col("surface_class"))
    allowed = (~F.col("is_street") | F.col("walkway")) & costs.profile_allowed(F.abs("grade"), F.lit(25.0), F.col("risk"), F.lit(True), F.col("bridge_or_tunnel"))
    return rows.groupBy("way_id", "pos").agg(F.round(F.min(costs.edge_cost(allowed, minutes, F.col("risk"), F.lit(True))), 6).alias("cost"))


def connector_step_cost(spark, d):
    rows = origins(spark, d).withColumn("flavor", F.explode(F.array(*map(F.lit, costs.FLAVORS))))
    cost = costs.connector_step_cost(F.col("max_off_trail_meters") / 60, costs.aversion(F.col("flavor"), F.col("off_trail_aversion")), F.col("max_grade_percent"), F.col("request_id") % 10 / 10.0, F.col("avoid_water"))
    return rows.select("request_id", "flavor", F.round(cost, 6).alias("cost"))


def flavor_settings(spark, d):
    rows = origins(spark, d).withColumn("flavor", F.explode(F.array(*map(F.lit, costs.FLAVORS))))
    return rows.select("request_id", "flavor", costs.aversion(F.col("flavor"), F.col("off_trail_aversion")).alias("aversion"), costs.off_trail_budget(F.col("flavor"), F.col("max_off_trail_meters")).alias("budget"), costs.max_grade(F.col("max_grade_percent")).alias("max_grade"), costs.clamp_grade_limit(F.col("profile"), F.col("max_grade_percent")).alias("limit_percent"))


def network_sssp(spark, d):
    """Nodes within 60 m of walking from each opening's nearest node, over open ways."""
    from crestline.operators.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    key = lambda lat, lng: F.concat_ws(",", F.col(lat).cast("string"), F.col(lng).cast("string"))
    links = _edges(spark, d).select(key("from_lat", "from_lng").alias("node"), key("to_lat", "to_lng").alias("other"), F.col("meters").alias("cost"))
    asked = openings(spark, d).withColumnRenamed("opening_id", "request_id")
    start = network.nearest_nodes(asked, network.nodes(vertices(spark, d), ways(spark, d)), 1).select(F.col("request_id").alias("source"), key("lat_e6", "lng_e6").alias("node"))
    return network.reach(start, links, 60.0).select("source", "node", r("cost"))


QUERIES = {f.__name__: f for f in (surface_class, access_restricted, walkway_evidence, way_flags, category_precedence, blocks_on_foot, graph_nodes, graph_edges, interior_crossings, graph_stats, crossing_points, near_crossing_semi, barrier_violation_anti, nearest_nodes_topk, segment_profile, edge_cost, connector_step_cost, flavor_settings, network_sssp)}

KNOWN = """
SELECT *, category = 'path' OR highway = 'track' AS is_path, category = 'road' AND highway <> 'track' AS is_street,
  category = 'path' OR highway = 'track' OR coalesce(lower(trim(sidewalk)), '') IN ('yes', 'both', 'left', 'right', 'separate') AS walkway,
  CASE WHEN f IN ('yes', 'designated', 'permissive', 'destination') THEN false WHEN f IN ('no', 'private') THEN true ELSE a IN ('private', 'no') END AS restricted,
  CASE WHEN highway = 'steps' THEN 'steps' WHEN contains(s, 'paved') THEN 'paved' WHEN contains(s, 'gravel') THEN 'gravel' WHEN s <> '' THEN 'natural-trail'
    WHEN tracktype = 'grade1' THEN 'paved' WHEN tracktype IN ('grade2', 'grade3') THEN 'gravel' WHEN tracktype IS NOT NULL THEN 'natural-trail' WHEN category = 'road' THEN 'paved' ELSE 'natural-trail' END AS surface_class,
  bridge IS NOT NULL AS bridge_or_tunnel, coalesce(try_cast(layer AS DOUBLE), 0.0::DOUBLE) AS layer_number, crossing IS NOT NULL AS tagged_crossing
FROM (SELECT *, coalesce(lower(trim(foot)), '') AS f, coalesce(lower(trim(access)), '') AS a, coalesce(lower(trim(surface)), '') AS s FROM ways)"""
E6 = lambda x: f"{js(f'({x}) * 1e6')}::BIGINT"
METERS = "sqrt(pow((b_lng - a_lng) * (111132.0::DOUBLE * cos((a_lat + b_lat) / 2 * pi() / 180)), 2) + pow((b_lat - a_lat) * 111132.0::DOUBLE, 2))"
NODES = f"""
SELECT {E6('lat')} AS lat_e6, {E6('lng')} AS lng_e6, arg_min(lat, (way_id, pos)) AS lat, arg_min(lng, (way_id, pos)) AS lng, bool_or(is_path) AS path_evidence
FROM vertices JOIN known USING (way_id) WHERE NOT restricted GROUP BY 1, 2"""
EDGES = f"""
SELECT e.*, is_path AND ((pos > 1 AND s1.x IS NOT NULL) OR (pos + 1 < vertices_in_way AND s2.x IS NOT NULL)) AS crosses_street FROM (
  SELECT *, {METERS} AS meters, {E6('a_lat')} AS from_lat, {E6('a_lng')} AS from_lng, {E6('b_lat')} AS to_lat, {E6('b_lng')} AS to_lng FROM segments JOIN known USING (way_id) WHERE NOT restricted) e
LEFT JOIN streets s1 ON s1.x = from_lat AND s1.y = from_lng LEFT JOIN streets s2 ON s2.x = to_lat AND s2.y = to_lng
WHERE meters >= 0.5 AND (from_lat <> to_lat OR from_lng <> to_lng)"""
STREETS = f"SELECT DISTINCT {E6('lat')} AS x, {E6('lng')} AS y FROM vertices JOIN known USING (way_id) WHERE is_street AND NOT restricted"
MORE = {"known": KNOWN, "nodes": NODES, "streets": STREETS, "edges": EDGES}


def q(select: str, views: str) -> str:
    """select under views of the tables and of this module, in order."""
    from .views import SQL_VIEWS

    return "WITH " + ", ".join(f"{n} AS ({(SQL_VIEWS | MORE)[n]})" for n in views.split()) + "\n" + select


def met(columns: str, source: str) -> str:
    """lat, lng where a-b meets c-d for rows of source, parallel pairs at their first shared end."""
    from .tracks import SHARED

    flat = ", ".join(f"{p}_lng * (111132.0::DOUBLE * cos(ref * pi() / 180)) AS {p}_x, {p}_lat * 111132.0::DOUBLE AS {p}_y" for p in "abcd")
    pick = lambda k: f"CASE WHEN abs(den) < 1e-5 THEN {SHARED[k]} WHEN t BETWEEN -1e-5 AND 1.00001 AND u BETWEEN -1e-5 AND 1.00001 THEN a_{k} + (b_{k} - a_{k}) * t END AS {k}"
    return f"""SELECT {columns}, {pick('lat')}, {pick('lng')} FROM (
  SELECT *, ((a_x - c_x) * (c_y - d_y) - (a_y - c_y) * (c_x - d_x)) / nullif(den, 0) AS t, ((a_x - c_x) * (a_y - b_y) - (a_y - c_y) * (a_x - b_x)) / nullif(den, 0) AS u FROM (
    SELECT *, (a_x - b_x) * (c_y - d_y) - (a_y - b_y) * (c_x - d_x) AS den FROM (SELECT *, {flat} FROM (SELECT *, (a_lat + b_lat + c_lat + d_lat) / 4 AS ref FROM ({source})))))"""


def nearest(asked: str, limit: int) -> str:
    """The nearest nodes of the rows of asked (request_id, lat, lng), by rings of buckets."""
    return f"""SELECT request_id, k AS rank, lat_e6, lng_e6, round(meters, 4) AS meters FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(meters, 6), lat_e6, lng_e6) AS k FROM (
  SELECT *, min(CASE WHEN held >= {2 * limit} THEN ring END) OVER (PARTITION BY request_id) AS last FROM (SELECT *, count(*) OVER (PARTITION BY request_id ORDER BY ring) AS held FROM (
    SELECT o.request_id, lat_e6, lng_e6, sqrt(pow((n.lng - o.lng) * (111132.0::DOUBLE * cos((o.lat + n.lat) / 2 * pi() / 180)), 2) + pow((n.lat - o.lat) * 111132.0::DOUBLE, 2)) AS meters,
      (SELECT min(g) FROM range(1, 9) t(g) WHERE floor(n.lat / 0.001) BETWEEN floor((o.lat - g * 0.001::DOUBLE) / 0.001) AND floor((o.lat + g * 0.001::DOUBLE) / 0.001) AND floor(n.lng / 0.001) BETWEEN floor((o.lng - g * 0.001::DOUBLE) / 0.001) AND floor((o.lng + g * 0.001::DOUBLE) / 0.001)) AS ring
    FROM {asked} o JOIN nodes n ON abs(n.lat - o.lat) < 0.01 AND abs(n.lng - o.lng) < 0.01) WHERE ring IS NOT NULL)) WHERE ring <= coalesce(last, 8)) WHERE k <= {limit}"""


NEAR = "abs({0}.lat - {1}.lat) < 0.0006 AND abs({0}.lng - {1}.lng) < 0.0006 AND sqrt(pow(({1}.lng - {0}.lng) * (111132.0::DOUBLE * cos(({0}.lat + {1}.lat) / 2 * pi() / 180)), 2) + pow(({1}.lat - {0}.lat) * 111132.0::DOUBLE, 2)) <= {2}"
BOXES = "least(a_lat, b_lat) <= greatest(c_lat, d_lat) + 1e-5 AND greatest(a_lat, b_lat) >= least(c_lat, d_lat) - 1e-5 AND least(a_lng, b_lng) <= greatest(c_lng, d_lng) + 1e-5 AND greatest(a_lng, b_lng) >= least(c_lng, d_lng) - 1e-5"
SPEED = "greatest(6.0::DOUBLE, 4.6::DOUBLE * (exp(-3.5::DOUBLE * abs({g} + 0.05)) / exp(-3.5::DOUBLE * 0.05)) * {s} * 1000 / 60)"
SQL = {
    "surface_class": q("SELECT way_id, surface_class FROM known", "ways known"),
    "access_restricted": q("SELECT way_id, restricted FROM known", "ways known"),
    "walkway_evidence": q("SELECT way_id, is_path, is_street, walkway FROM known", "ways known"),
    "way_flags": q("SELECT way_id, bridge_or_tunnel, layer_number, tagged_crossing FROM known", "ways known"),
    "category_precedence": q("""SELECT way_id, CASE WHEN hw IN ('footway', 'steps') THEN 'path' WHEN hw IN ('residential', 'track') THEN 'road' WHEN category = 'road' OR foot = 'no' THEN 'water' WHEN access IS NOT NULL THEN 'barrier' END AS category
  FROM (SELECT *, CASE WHEN highway <> 'path' THEN highway END AS hw FROM ways)""", "ways"),
    "blocks_on_foot": q("""SELECT way_id, highway IN ('residential', 'track') AND f <> 'yes' AS blocks, highway = 'steps' AND a NOT IN ('private', 'no') AS opening FROM known""", "ways known"),
    "graph_nodes": q("SELECT lat_e6, lng_e6, round(lat, 7) AS lat, round(lng, 7) AS lng, path_evidence FROM nodes", "ways vertices known nodes"),
    "graph_edges": q("""SELECT from_lat, from_lng, to_lat, to_lng, way_id, pos, round(meters, 4) AS meters, surface_class, walkway FROM edges
  UNION ALL SELECT to_lat, to_lng, from_lat, from_lng, way_id, pos, round(meters, 4), surface_class, walkway FROM edges""", "ways vertices segments known streets edges"),
    "interior_crossings": q("SELECT DISTINCT way_id, pos FROM edges WHERE crosses_street", "ways vertices segments known streets edges"),
    "graph_stats": q("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT 2 * count(*) FROM edges) AS edges", "ways vertices segments known nodes streets edges"),
    "crossing_points": q(f"SELECT count(*) AS points FROM (SELECT DISTINCT {E6('lat')}, {E6('lng')} FROM (" + met("1 AS one", f"""SELECT p.a_lat, p.a_lng, p.b_lat, p.b_lng, s.a_lat AS c_lat, s.a_lng AS c_lng, s.b_lat AS d_lat, s.b_lng AS d_lng FROM side p JOIN side s ON p.k BETWEEN s.k - 1 AND s.k + 1 AND p.j BETWEEN s.j - 1 AND s.j + 1
  AND p.is_path AND s.is_street AND (p.tagged_crossing OR s.tagged_crossing) AND NOT (p.bridge_or_tunnel <> s.bridge_or_tunnel AND p.layer_number <> s.layer_number)""") + ") WHERE lat IS NOT NULL)", "ways vertices segments known").replace("\nSELECT count(*) AS points", ", side AS (SELECT *, floor(a_lat / 0.0005) AS k, floor(a_lng / 0.0005) AS j FROM segments JOIN known USING (way_id) WHERE NOT restricted)\nSELECT count(*) AS points"),
    "near_crossing_semi": q(f"SELECT request_id FROM origins o WHERE EXISTS (SELECT 1 FROM tagged t WHERE {NEAR.format('o', 't', 24)})", "ways vertices origins").replace("\nSELECT request_id", ", tagged AS (SELECT DISTINCT lat, lng FROM vertices SEMI JOIN (SELECT way_id FROM ways WHERE crossing IS NOT NULL) USING (way_id))\nSELECT request_id"),
    "barrier_violation_anti": q(f"SELECT way_id, pos FROM segments ANTI JOIN (SELECT way_id, pos FROM met WHERE lat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM openings o WHERE {NEAR.format('met', 'o', 12)})) USING (way_id, pos)", "vertices segments barriers openings").replace("\nSELECT way_id, pos FROM segments ANTI", ", met AS (" + met("way_id, pos", f"SELECT s.way_id, s.pos, s.a_lat, s.a_lng, s.b_lat, s.b_lng, b.a_lat AS c_lat, b.a_lng AS c_lng, b.b_lat AS d_lat, b.b_lng AS d_lng FROM segments s JOIN barriers b ON {BOXES.replace('a_', 's.a_').replace('b_', 's.b_').replace('c_', 'b.a_').replace('d_', 'b.b_')}") + ")\nSELECT way_id, pos FROM segments ANTI"),
    "nearest_nodes_topk": q(nearest("origins", 24), "ways vertices origins known nodes"),
    "segment_profile": q(f"""SELECT s.way_id, s.pos, round(coalesce(sum(step), 0), 4) + 0.0::DOUBLE AS distance_m, round(coalesce(sum(dz), 0), 4) + 0.0::DOUBLE AS change_m, round(coalesce(sum(greatest(dz, 0)), 0), 4) + 0.0::DOUBLE AS ascent_m, round(coalesce(sum(greatest(-dz, 0)), 0), 4) + 0.0::DOUBLE AS descent_m, round(coalesce(max(abs(dz / step)), 0), 4) + 0.0::DOUBLE AS max_grade,
  round(coalesce(sum(step / {SPEED.format(g='(dz / step)', s='0.92::DOUBLE')}), 0), 4) + 0.0::DOUBLE AS minutes
FROM segments s LEFT JOIN (SELECT way_id, pos, step, z - lag(z) OVER (PARTITION BY way_id, pos ORDER BY k) AS dz FROM (
  SELECT way_id, pos, k, step, d00.z * (1 - fc) * (1 - fr) + d01.z * fc * (1 - fr) + d10.z * (1 - fc) * fr + d11.z * fc * fr AS z FROM (
    SELECT *, y - floor(y) AS fr, x - floor(x) AS fc, floor(y)::BIGINT AS r0, floor(x)::BIGINT AS c0, least(floor(y)::BIGINT + 1, nr - 1) AS r1, least(floor(x)::BIGINT + 1, nc - 1) AS c1 FROM (
      SELECT way_id, pos, k, step, nr, nc, least(nr - 1.0::DOUBLE, greatest(0.0::DOUBLE, (54.4825::DOUBLE - (a_lat + (b_lat - a_lat) * (k / n::DOUBLE))) / 2.7e-4)) AS y, least(nc - 1.0::DOUBLE, greatest(0.0::DOUBLE, ((a_lng + (b_lng - a_lng) * (k / n::DOUBLE)) - 18.4525::DOUBLE) / 4.6e-4)) AS x
      FROM (SELECT *, m / n AS step, unnest(range(0, n + 1)) AS k FROM (SELECT *, greatest(1, ceil(m / 4))::BIGINT AS n FROM (SELECT *, {METERS} AS m FROM segments)) WHERE m / n >= 0.01), (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM dem)))
  JOIN dem d00 ON d00.r = r0 AND d00.c = c0 JOIN dem d01 ON d01.r = r0 AND d01.c = c1 JOIN dem d10 ON d10.r = r1 AND d10.c = c0 JOIN dem d11 ON d11.r = r1 AND d11.c = c1)) p ON p.way_id = s.way_id AND p.pos = s.pos AND p.dz IS NOT NULL
GROUP BY s.way_id, s.pos""", "vertices segments dem"),
    "edge_cost": q(f"""SELECT way_id, pos, round(CASE WHEN (NOT is_street OR walkway) AND abs(g) <= 0.25::DOUBLE + 0.005 AND NOT (risk > 0.55 AND NOT bridge_or_tunnel) THEN greatest(0.001, meters / {SPEED.format(g='g', s="(CASE surface_class WHEN 'paved' THEN 1.0 WHEN 'gravel' THEN 0.97 WHEN 'natural-trail' THEN 0.92 ELSE 0.42 END)::DOUBLE")} * (1 + risk * 6)) END, 6) AS cost
  FROM (SELECT *, (way_id % 10) / 10.0::DOUBLE AS risk, (pos % 7 - 3) / 10.0::DOUBLE AS g FROM edges)""", "ways vertices segments known streets edges"),
    "connector_step_cost": q("""SELECT request_id, flavor, round(max_off_trail_meters / 60 * CASE flavor WHEN 'mapped' THEN greatest(off_trail_aversion, 3.2::DOUBLE) WHEN 'direct' THEN 1 ELSE off_trail_aversion END * (1 + greatest(0.0::DOUBLE, least(0.6::DOUBLE, max_grade_percent / 60))) * (1 + (request_id % 10) / 10.0::DOUBLE * CASE WHEN avoid_water THEN 8 ELSE 1.5::DOUBLE END), 6) AS cost
  FROM origins CROSS JOIN (VALUES ('balanced'), ('direct'), ('mapped')) f(flavor)""", "origins"),
    "flavor_settings": q("""SELECT request_id, flavor, CASE flavor WHEN 'mapped' THEN greatest(off_trail_aversion, 3.2::DOUBLE) WHEN 'direct' THEN 1.0::DOUBLE ELSE off_trail_aversion END AS aversion, CASE flavor WHEN 'direct' THEN greatest(max_off_trail_meters, 900.0::DOUBLE) ELSE max_off_trail_meters END AS budget, greatest(0.02::DOUBLE, max_grade_percent / 100) AS max_grade,
  least(CASE profile WHEN 'hiker' THEN 60.0 WHEN 'runner' THEN 45.0 ELSE 25.0 END::DOUBLE, greatest(5.0::DOUBLE, max_grade_percent)) AS limit_percent FROM origins CROSS JOIN (VALUES ('balanced'), ('direct'), ('mapped')) f(flavor)""", "origins"),
    "network_sssp": q("SELECT source, node, round(min(cost), 4) AS cost FROM reached GROUP BY source, node", "ways vertices segments openings known nodes streets edges").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT source, node", f""", start AS ({nearest("(SELECT opening_id AS request_id, lat, lng FROM openings)", 1)}),
links AS (SELECT a, b, min(meters) AS step FROM (SELECT from_lat || ',' || from_lng AS a, to_lat || ',' || to_lng AS b, meters FROM edges UNION ALL SELECT to_lat || ',' || to_lng, from_lat || ',' || from_lng, meters FROM edges) GROUP BY a, b),
reached AS (SELECT request_id AS source, lat_e6 || ',' || lng_e6 AS node, 0.0::DOUBLE AS cost FROM start UNION SELECT source, b, cost + step FROM reached JOIN links ON a = node WHERE cost + step <= 60)
SELECT source, node"""),
}
SQL["graph_stats"] = f"SELECT g.*, c.points AS crossings, b.barriers, o.openings FROM ({SQL['graph_stats']}) g, ({SQL['crossing_points']}) c, ({with_views('barriers', 'SELECT count(*) AS barriers FROM barriers')}) b, ({with_views('openings', 'SELECT count(*) AS openings FROM openings')}) o"
