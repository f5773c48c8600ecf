"""Queries over the elevation raster that parts make."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.operators import mosaics, raster, terrain
from crestline.operators.checkpoints import shared_folder

from .views import LAT_STEP, LNG_STEP, NORTH, WEST, dem, table, track_points, water_lines, with_views

NS, EW = LAT_STEP * 111_132.0, 30.0
PLACE = (NORTH, WEST, LAT_STEP, LNG_STEP)


def r(name, places=6):
    return F.round(name, places).alias(name)


def grid_min_max(spark, d):
    return raster.extent(dem(spark, d))


def grid_geometry(spark, d):
    cells = dem(spark, d)
    return cells.select("r", "c", F.round(F.lit(NORTH) - F.col("r") * LAT_STEP, 9).alias("lat"), F.round(F.lit(WEST) + F.col("c") * LNG_STEP, 9).alias("lng"))


def bilinear_sample(spark, d):
    return raster.sample(track_points(spark, d).select("user_id", "seq", "lat", "lng"), dem(spark, d), ["user_id", "seq"], *PLACE).select("user_id", "seq", r("z"))


def smooth_grid(spark, d):
    return raster.smooth(dem(spark, d), 2).select("r", "c", r("z"))


def horn_slope(spark, d):
    return raster.horn_slope(dem(spark, d), NS, EW).select("r", "c", r("slope"))


def slope_mean_max_by_cell(spark, d):
    return raster.slope_by_cell(dem(spark, d), 3, NS, EW).select("cell_r", "cell_c", r("mean_slope"), r("max_slope"))


def ruggedness(spark, d):
    return raster.ruggedness(dem(spark, d)).select("r", "c", r("ruggedness"))


def water_risk(spark, d):
    size = raster.extent(dem(spark, d)).select("rows", "columns")
    lines = water_lines(spark, d).crossJoin(F.broadcast(size))  # one row
    found = raster.water_risk(lines, F.col("rows"), F.col("columns"), *PLACE, 30.0)
    return dem(spark, d).select("r", "c").join(found, ["r", "c"], "left").select("r", "c", F.round(F.coalesce("risk", F.lit(0.0)), 6).alias("risk"))


def terrain_at_points(spark, d):
    """Height, slope, ruggedness and water risk where each track point lies, from a stored terrain."""
    cells = dem(spark, d).join(raster.horn_slope(dem(spark, d), NS, EW), ["r", "c"]).join(raster.ruggedness(dem(spark, d)), ["r", "c"]).join(water_risk(spark, d), ["r", "c"])
    name = f"terrain_{uuid.uuid4().hex}"
    stored = terrain.TerrainTiles.create(cells, PLACE, name, f"{shared_folder(spark)}/{name}")
    found = stored.at(track_points(spark, d).select("user_id", "seq", "lat", "lng"), ["user_id", "seq"])
    return found.select("user_id", "seq", *map(r, terrain.MEASURES))


def contour_interval(spark, d):
    return raster.extent(dem(spark, d)).select((F.col("high") - F.col("low")).alias("relief"), raster.suggest_interval(F.col("high") - F.col("low")).alias("interval"))


def marching_squares(spark, d):
    return raster.marching_squares(dem(spark, d), 10.0).select("level", "r", "c", "part", *(r(x) for x in ("a_r", "a_c", "b_r", "b_c")))


def hillshade(spark, d):
    return raster.hillshade(dem(spark, d), NS, EW).select("r", "c", r("grey", 4))


def hypsometric_tint(spark, d):
    cells = dem(spark, d).crossJoin(F.broadcast(raster.extent(dem(spark, d)).select("low", "high")))  # one row
    return raster.tint(cells, F.col("low"), F.col("high")).select("r", "c", *(r(x, 4) for x in ("red", "green", "blue")))


def local_elevation_range(spark, d):
    box = track_points(spark, d).groupBy("user_id").agg(F.max("lat").alias("n"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.min("lng").alias("w"))
    return raster.local_range(dem(spark, d), box, *PLACE)


def terrarium_decode(spark, d):
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key, F.round(geo.terrarium_height(key % 256, key * 7 % 256, key * 13 % 256), 6).alias("height"))


ZOOM, BOX = 9, {"north": NORTH, "south": 54.4325, "west": WEST, "east": WEST + 0.09}


def tile_mosaic_sample(spark, d):
    """Track points on height tiles of 256 pixels: the raster stands at the tile pixel of its corner."""
    code = F.col("z").cast("int") + 32768
    at = dem(spark, d).select((F.col("c") + X_PIXEL).alias("px"), (F.col("r") + Y_PIXEL).alias("py"), code.alias("code"))
    tiles = at.select(F.floor(F.col("px") / 256).alias("x"), F.floor(F.col("py") / 256).alias("y"), (F.col("py") % 256).alias("r"), (F.col("px") % 256).alias("c"), F.floor(F.col("code") / 256).cast("int").alias("red"), (F.col("code") % 256).alias("green"), F.lit(0).alias("blue"))
    points = track_points(spark, d).select("user_id", "seq", "lat", "lng")
    return mosaics.sample_tiles(points, tiles, BOX, ZOOM).select("user_id", "seq", r("z", 2))


def survey_mosaic_sample(spark, d):
    """Points of customers on survey grids of ten by ten cells that overlap by one; the first grid counts."""
    key = F.col("p_partkey")
    cells = table(spark, d, "part").select(F.floor(key / 100).alias("file"), F.floor(key % 100 / 10).alias("r"), (key % 10).alias("c"), F.col("p_size").cast("double").alias("z"))
    grids = cells.select("file").distinct().select("file", F.lit(10).alias("rows"), F.lit(10).alias("columns"), F.lit(5.0).alias("dx"), F.lit(5.0).alias("dy"), (F.col("file") % 10 * 45.0).alias("west"), (F.floor(F.col("file") / 10) * 45.0).alias("south"))
    who = F.col("c_custkey")
    points = table(spark, d, "customer").select(who.alias("point_id"), (who * 37 % 4600 / 10.0).alias("px"), (who * 53 % 2000 / 10.0).alias("py"))
    return mosaics.sample_surveys(points, ["point_id"], grids, cells).select("point_id", "file", r("z", 4))


def render_raster(spark, d):
    size = raster.extent(dem(spark, d)).first()  # one row
    picture = raster.rendered(dem(spark, d), size["rows"], size["columns"], *PLACE)
    tinted = raster.rendered(dem(spark, d), size["rows"], size["columns"], *PLACE, hypsometric=True)
    return picture.select("y", "x", r("red", 2).alias("grey"), "alpha").join(tinted.select("y", "x", r("red", 2), r("green", 2), r("blue", 2)), ["y", "x"])


# The pixel of the whole map at which the raster's corner stands.
X_PIXEL, _, Y_PIXEL, _ = mosaics.tile_range(BOX, ZOOM + 8)
QUERIES = {f.__name__: f for f in (tile_mosaic_sample, survey_mosaic_sample, render_raster, grid_min_max, grid_geometry, bilinear_sample, smooth_grid, horn_slope, slope_mean_max_by_cell, ruggedness, water_risk, terrain_at_points, contour_interval, marching_squares, hillshade, hypsometric_tint, local_elevation_range, terrarium_decode)}

STENCIL = """
SELECT r, c, z, w, e, coalesce(lag(w) OVER k, w) AS nw, coalesce(lag(z) OVER k, z) AS n, coalesce(lag(e) OVER k, e) AS ne, coalesce(lead(w) OVER k, w) AS sw, coalesce(lead(z) OVER k, z) AS s, coalesce(lead(e) OVER k, e) AS se
FROM (SELECT r, c, z, coalesce(lag(z) OVER j, z) AS w, coalesce(lead(z) OVER j, z) AS e FROM dem WINDOW j AS (PARTITION BY r ORDER BY c)) WINDOW k AS (PARTITION BY c ORDER BY r)"""
SLOPE = f"""
SELECT r, c, atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * 30.0::DOUBLE), 2) + pow(((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * (2.7e-4 * 111132.0::DOUBLE)), 2))) * 180 / pi() AS slope FROM ({STENCIL})"""
SIZE = "(SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM dem)"


def smoothed(source: str) -> str:
    for axis in ("PARTITION BY r ORDER BY c", "PARTITION BY c ORDER BY r"):
        source = f"SELECT r, c, (coalesce(lag(z) OVER w, z) + 2 * z + coalesce(lead(z) OVER w, z)) / 4 AS z FROM ({source}) WINDOW w AS ({axis})"
    return source


def ramp(k: int) -> str:
    cases = " ".join(f"WHEN p <= {s1} THEN {c0[k]} + ({c1[k] - c0[k]}) * ((p - {s0}::DOUBLE) / ({s1}::DOUBLE - {s0}::DOUBLE))" for (s0, c0), (s1, c1) in zip(raster.RAMP[:-1], raster.RAMP[1:], strict=True))
    return f"round(CASE {cases} ELSE {raster.RAMP[-1][1][k]} END, 4)"


def js(x: str) -> str:
    return f"(floor({x}) + CASE WHEN ({x}) - floor({x}) >= 0.5 THEN 1 ELSE 0 END)"


WEIGHED = "CASE WHEN {w} = 0 THEN 0 ELSE {z} * ({w}) END"
FOUR = " + ".join(WEIGHED.format(w=w, z=z) for w, z in (("(1 - fc) * (1 - fr)", "a.z"), ("fc * (1 - fr)", "b.z"), ("(1 - fc) * fr", "e.z"), ("fc * fr", "f.z")))


def between(points: str, cells: str, of: str = "") -> str:
    """SQL of heights between cells: points (y, x, nr, nc) with z."""
    same = f" AND {{0}}.{of} = p.{of}" if of else ""
    joins = " ".join(f"LEFT JOIN {cells} {t} ON {t}.r = p.{r_} AND {t}.c = p.{c_}{same.format(t)}" for t, r_, c_ in (("a", "r0", "c0"), ("b", "r0", "c1"), ("e", "r1", "c0"), ("f", "r1", "c1")))
    return f"SELECT p.*, {FOUR} AS z FROM (SELECT *, y - floor(y) AS fr, x - floor(x) AS fc, floor(y)::BIGINT AS r0, floor(x)::BIGINT AS c0, least(floor(y)::BIGINT + 1, nr - 1) AS r1, least(floor(x)::BIGINT + 1, nc - 1) AS c1 FROM ({points})) p {joins}"


MX0, MX1, MY0, MY1 = mosaics.tile_range(BOX, ZOOM)
MERCATOR = f"(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {2.0**ZOOM}::DOUBLE * 256 - {MY0 * 256}"
FADE = "least(255::DOUBLE * least(least(c / greatest(1.0::DOUBLE, w * 0.035::DOUBLE), (w - 1 - c) / greatest(1.0::DOUBLE, w * 0.035::DOUBLE)), least(r / greatest(1.0::DOUBLE, h * 0.035::DOUBLE), (h - 1 - r) / greatest(1.0::DOUBLE, h * 0.035::DOUBLE)), 1.0::DOUBLE))"
PICTURE = between(f"""SELECT i.r, j.c, w, h, nr, nc, lo, hi, least(nr - 1.0::DOUBLE, greatest(0.0::DOUBLE, (54.4825::DOUBLE - (54.4825::DOUBLE - (i.r + 0.5::DOUBLE) / h * ((nr - 1) * 2.7e-4))) / 2.7e-4)) AS y, least(nc - 1.0::DOUBLE, greatest(0.0::DOUBLE, ((18.4525::DOUBLE + (j.c + 0.5::DOUBLE) / w * ((nc - 1) * 4.6e-4)) - 18.4525::DOUBLE) / 4.6e-4)) AS x
  FROM (SELECT *, least(1400, nr * 2) AS h, least(1400, nc * 2) AS w FROM (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc, min(z) AS lo, max(z) AS hi FROM dem)), (SELECT unnest(range(1400)) AS r) i, (SELECT unnest(range(1400)) AS c) j WHERE i.r < h AND j.c < w""", "dem")
L, R, T, B = "[nw_sw, c]", "[ne_se, c + 1]", "[r::DOUBLE, nw_ne]", "[r + 1::DOUBLE, sw_se]"
SQL = {
    "tile_mosaic_sample": with_views("track_points dem", "SELECT user_id, seq, round(z, 2) AS z FROM (" + between(f"""SELECT user_id, seq, {(MY1 - MY0 + 1) * 256} AS nr, {(MX1 - MX0 + 1) * 256} AS nc,
    least({(MY1 - MY0 + 1) * 256 - 1}::DOUBLE, greatest(0.0::DOUBLE, {MERCATOR})) AS y, least({(MX1 - MX0 + 1) * 256 - 1}::DOUBLE, greatest(0.0::DOUBLE, (lng + 180) / 360 * {2.0**ZOOM}::DOUBLE * 256 - {MX0 * 256})) AS x FROM track_points""", f"(SELECT r + {Y_PIXEL - MY0 * 256} AS r, c + {X_PIXEL - MX0 * 256} AS c, z FROM dem)") + ")"),
    "survey_mosaic_sample": "WITH cells AS (SELECT p_partkey // 100 AS file, p_partkey % 100 // 10 AS r, p_partkey % 10 AS c, p_size::DOUBLE AS z FROM part), points AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 4600) / 10.0::DOUBLE AS px, (c_custkey * 53 % 2000) / 10.0::DOUBLE AS py FROM customer),\n"
    "held AS (SELECT point_id, min(file) AS file, any_value(px) AS px, any_value(py) AS py FROM points, (SELECT DISTINCT file FROM cells) WHERE px BETWEEN file % 10 * 45 AND file % 10 * 45 + 50 AND py BETWEEN file // 10 * 45 AND file // 10 * 45 + 50 GROUP BY point_id)\n"
    "SELECT point_id, file, round(z, 4) AS z FROM points LEFT JOIN (" + between("SELECT point_id, file, 10 AS nr, 10 AS nc, least(9.0::DOUBLE, greatest(0.0::DOUBLE, 10 - 0.5::DOUBLE - (py - file // 10 * 45.0::DOUBLE) / 5.0::DOUBLE)) AS y, least(9.0::DOUBLE, greatest(0.0::DOUBLE, (px - file % 10 * 45.0::DOUBLE) / 5.0::DOUBLE - 0.5::DOUBLE)) AS x FROM held", "cells", "file") + ") q USING (point_id)",
    "render_raster": with_views("dem", f"""SELECT r AS y, c AS x, {ramp(0).replace(', 4)', ', 2)')} AS red, {ramp(1).replace(', 4)', ', 2)')} AS green, {ramp(2).replace(', 4)', ', 2)')} AS blue, {js(FADE)}::BIGINT AS alpha,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + (greatest(0.0::DOUBLE, sin(radians(46.0::DOUBLE)) * cos(sl) + cos(radians(46.0::DOUBLE)) * sin(sl) * cos(radians(315.0::DOUBLE) - asp)) - sin(radians(46.0::DOUBLE))) * 1.15::DOUBLE)) * 255, 2) AS grey
  FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + ((z - lo) / greatest(hi - lo, 1.0) - 0.5) * 1.5::DOUBLE)) AS p, atan(sqrt(dx * dx + dy * dy)) AS sl, atan2(dy, -dx) AS asp FROM (
    SELECT *, (coalesce(lead(z) OVER j, z) - coalesce(lag(z) OVER j, z)) / (2 * (4.6e-4 * nc * 111132.0::DOUBLE * cos(radians(54.4825::DOUBLE)) / w)) * 2.8::DOUBLE AS dx, (coalesce(lead(z) OVER k, z) - coalesce(lag(z) OVER k, z)) / (2 * (2.7e-4 * nr * 111132.0::DOUBLE / h)) * 2.8::DOUBLE AS dy
    FROM ({PICTURE}) WINDOW j AS (PARTITION BY r ORDER BY c), k AS (PARTITION BY c ORDER BY r)))"""),
    "grid_min_max": with_views("dem", 'SELECT max(r) + 1 AS rows, max(c) + 1 AS "columns", min(z) AS low, max(z) AS high FROM dem'),
    "grid_geometry": with_views("dem", "SELECT r, c, round(54.4825::DOUBLE - r * 2.7e-4, 9) AS lat, round(18.4525::DOUBLE + c * 4.6e-4, 9) AS lng FROM dem"),
    "bilinear_sample": with_views("track_points dem", f"""SELECT p.user_id, p.seq, round(sum(z * CASE WHEN dem.r = r0 AND dem.c = c0 THEN (1 - fc) * (1 - fr) ELSE 0 END + z * CASE WHEN dem.r = r0 AND dem.c = c1 THEN fc * (1 - fr) ELSE 0 END
  + z * CASE WHEN dem.r = r1 AND dem.c = c0 THEN (1 - fc) * fr ELSE 0 END + z * CASE WHEN dem.r = r1 AND dem.c = c1 THEN fc * fr ELSE 0 END), 6) AS z
  FROM (SELECT *, y - floor(y) AS fr, x - floor(x) AS fc, floor(y)::BIGINT AS r0, floor(x)::BIGINT AS c0, least(floor(y)::BIGINT + 1, nr - 1) AS r1, least(floor(x)::BIGINT + 1, nc - 1) AS c1 FROM (
    SELECT user_id, seq, track_points.z AS tz, nr, nc, least(nr - 1.0::DOUBLE, greatest(0.0::DOUBLE, (54.4825::DOUBLE - lat) / 2.7e-4)) AS y, least(nc - 1.0::DOUBLE, greatest(0.0::DOUBLE, (lng - 18.4525::DOUBLE) / 4.6e-4)) AS x FROM track_points, {SIZE})) p
  JOIN dem ON (dem.r = r0 OR dem.r = r1) AND (dem.c = c0 OR dem.c = c1) GROUP BY p.user_id, p.seq"""),
    "smooth_grid": with_views("dem", f"SELECT r, c, round(z, 6) AS z FROM ({smoothed(smoothed('SELECT * FROM dem'))})"),
    "horn_slope": with_views("dem", f"SELECT r, c, round(slope, 6) AS slope FROM ({SLOPE})"),
    "slope_mean_max_by_cell": with_views("dem", f"SELECT least({js('r / 3.0::DOUBLE')}, ceil((nr - 1) / 3.0))::BIGINT AS cell_r, least({js('c / 3.0::DOUBLE')}, ceil((nc - 1) / 3.0))::BIGINT AS cell_c, round(avg(slope), 6) AS mean_slope, round(max(slope), 6) AS max_slope FROM ({SLOPE}), {SIZE} GROUP BY 1, 2"),
    "ruggedness": with_views("dem", f"SELECT r, c, round((abs(nw - z) + abs(n - z) + abs(ne - z) + abs(w - z) + abs(e - z) + abs(sw - z) + abs(s - z) + abs(se - z)) / 8, 6) AS ruggedness FROM ({STENCIL})"),
    "water_risk": with_views("dem water_lines", f"""SELECT dem.r, dem.c, round(coalesce(risk, 0), 6) AS risk FROM dem LEFT JOIN (
  SELECT r, c, max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - sqrt(pow((18.4525::DOUBLE + c * 4.6e-4 - lng) * (111132.0::DOUBLE * cos((lat + 54.4825::DOUBLE - r * 2.7e-4) / 2 * pi() / 180)), 2) + pow((54.4825::DOUBLE - r * 2.7e-4 - lat) * 111132.0::DOUBLE, 2)) / 26))) AS risk
  FROM (SELECT lat, lng, ({js('(54.4825::DOUBLE - lat) / 2.7e-4')} + dr)::BIGINT AS r, ({js('(lng - 18.4525::DOUBLE) / 4.6e-4')} + dc)::BIGINT AS c FROM (
    SELECT a_lat + (b_lat - a_lat) * (k / n::DOUBLE) AS lat, a_lng + (b_lng - a_lng) * (k / n::DOUBLE) AS lng FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (
      SELECT *, greatest(1, ceil(sqrt(pow((b_lng - a_lng) * (111132.0::DOUBLE * cos((a_lat + b_lat) / 2 * pi() / 180)), 2) + pow((b_lat - a_lat) * 111132.0::DOUBLE, 2)) / 15))::BIGINT AS n FROM water_lines)))
    CROSS JOIN (VALUES (-1), (0), (1)) i(dr) CROSS JOIN (VALUES (-1), (0), (1)) j(dc)) GROUP BY r, c) s ON dem.r = s.r AND dem.c = s.c"""),
    "contour_interval": with_views("dem", 'SELECT relief, coalesce((SELECT min(i) FROM (VALUES (1.0::DOUBLE), (2), (2.5), (5), (10), (20), (25), (50), (100)) v(i) WHERE relief / i <= 22), 200) AS "interval" FROM (SELECT max(z) - min(z) AS relief FROM dem)'),
    "marching_squares": with_views("dem", f"""SELECT level, r, c, part, round(s[1], 6) AS a_r, round(s[2], 6) AS a_c, round(s[3], 6) AS b_r, round(s[4], 6) AS b_c FROM (
  SELECT level, r, c, unnest(segs) AS s, unnest(range(len(segs)))::INT AS part FROM (
    SELECT *, CASE WHEN code IN (1, 14) THEN [{L} || {B}] WHEN code IN (2, 13) THEN [{B} || {R}] WHEN code IN (3, 12) THEN [{L} || {R}] WHEN code IN (4, 11) THEN [{T} || {R}] WHEN code IN (6, 9) THEN [{T} || {B}] WHEN code IN (7, 8) THEN [{L} || {T}]
      WHEN (code = 5 AND (nw + ne + sw + se) / 4 < level) OR (code = 10 AND (nw + ne + sw + se) / 4 >= level) THEN [{L} || {T}, {B} || {R}] ELSE [{L} || {B}, {T} || {R}] END AS segs FROM (
      SELECT *, (CASE WHEN nw >= level THEN 8 ELSE 0 END) + (CASE WHEN ne >= level THEN 4 ELSE 0 END) + (CASE WHEN se >= level THEN 2 ELSE 0 END) + (CASE WHEN sw >= level THEN 1 ELSE 0 END) AS code,
        c + (level - nw) / nullif(ne - nw, 0) AS nw_ne, c + (level - sw) / nullif(se - sw, 0) AS sw_se, r + (level - nw) / nullif(sw - nw, 0) AS nw_sw, r + (level - ne) / nullif(se - ne, 0) AS ne_se
      FROM (SELECT *, unnest(range(1, 100)) * 10.0::DOUBLE AS level FROM (
        SELECT r, c, z AS nw, ne, lead(z) OVER k AS sw, lead(ne) OVER k AS se FROM (SELECT r, c, z, lead(z) OVER (PARTITION BY r ORDER BY c) AS ne FROM dem) WINDOW k AS (PARTITION BY c ORDER BY r)) WHERE ne IS NOT NULL AND se IS NOT NULL)) WHERE code NOT IN (0, 15)))"""),
    "hillshade": with_views("dem", f"""SELECT r, c, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + (greatest(0.0::DOUBLE, sin(radians(46.0::DOUBLE)) * cos(sl) + cos(radians(46.0::DOUBLE)) * sin(sl) * cos(radians(315.0::DOUBLE) - asp)) - sin(radians(46.0::DOUBLE))) * 1.15::DOUBLE)) * 255, 4) AS grey
  FROM (SELECT r, c, atan(sqrt(dx * dx + dy * dy)) AS sl, atan2(dy, -dx) AS asp FROM (SELECT r, c, (e - w) / (2 * 30.0::DOUBLE) * 2.8::DOUBLE AS dx, (s - n) / (2 * (2.7e-4 * 111132.0::DOUBLE)) * 2.8::DOUBLE AS dy FROM ({STENCIL})))"""),
    "hypsometric_tint": with_views("dem", f"SELECT r, c, {ramp(0)} AS red, {ramp(1)} AS green, {ramp(2)} AS blue FROM (SELECT r, c, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + ((z - lo) / greatest(hi - lo, 1.0) - 0.5) * 1.5::DOUBLE)) AS p FROM dem, (SELECT min(z) AS lo, max(z) AS hi FROM dem))"),
    "local_elevation_range": with_views("track_points dem", f"""SELECT user_id, CASE WHEN hi - lo >= 1 THEN lo ELSE la END AS low, CASE WHEN hi - lo >= 1 THEN hi ELSE ha END AS high FROM (
  SELECT user_id, min(z) AS lo, max(z) AS hi, any_value(la) AS la, any_value(ha) AS ha FROM (
    SELECT user_id, la, ha, least(nr - 1, greatest(0, {js('(54.4825::DOUBLE - (n + pa)) / 2.7e-4')})) AS r0, least(nr - 1, greatest(0, {js('(54.4825::DOUBLE - (s - pa)) / 2.7e-4')})) AS r1, least(nc - 1, greatest(0, {js('((w - pl) - 18.4525::DOUBLE) / 4.6e-4')})) AS c0, least(nc - 1, greatest(0, {js('((e + pl) - 18.4525::DOUBLE) / 4.6e-4')})) AS c1
    FROM (SELECT *, 150 / 111320.0::DOUBLE AS pa, 150 / (111320.0::DOUBLE * cos((n + s) / 2 * pi() / 180)) AS pl FROM (SELECT user_id, max(lat) AS n, min(lat) AS s, max(lng) AS e, min(lng) AS w FROM track_points GROUP BY user_id)), {SIZE}, (SELECT min(z) AS la, max(z) AS ha FROM dem)) b
  JOIN dem ON dem.r BETWEEN r0 AND r1 AND dem.c BETWEEN c0 AND c1 GROUP BY user_id)"""),
    "terrarium_decode": "SELECT p_partkey, round((p_partkey % 256) * 256.0::DOUBLE + (p_partkey * 7) % 256 + ((p_partkey * 13) % 256) / 256.0::DOUBLE - 32768, 6) AS height FROM part",
}
CELL = f"SELECT user_id, seq, least(nr - 1, greatest(0, {js('(54.4825::DOUBLE - lat) / 2.7e-4')}))::BIGINT AS r, least(nc - 1, greatest(0, {js('(lng - 18.4525::DOUBLE) / 4.6e-4')}))::BIGINT AS c FROM track_points, {SIZE}"
SQL["terrain_at_points"] = with_views("track_points dem", f"""SELECT user_id, seq, b.z, s.slope, g.ruggedness, w.risk FROM ({SQL['bilinear_sample']}) b JOIN ({CELL}) p USING (user_id, seq)
  LEFT JOIN ({SQL['horn_slope']}) s USING (r, c) LEFT JOIN ({SQL['ruggedness']}) g USING (r, c) LEFT JOIN ({SQL['water_risk']}) w USING (r, c)""")
