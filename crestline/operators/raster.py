"""Elevation rasters in long form: rows (r, c, z), row 0 in the north, column 0 in the west."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.functions.numeric import clamp, js_round

WATER_REACH = 26.0
TILE = 4  # cells along a square of the raster that is joined whole
FAN = 4  # nodes of a pyramid along a node of the level above
# Sun and relief, the part of a picture's side that fades, and the ramp of the hypsometric tint.
SUN_AZIMUTH, SUN_ALTITUDE = math.radians(315.0), math.radians(46.0)
RELIEF_EXAGGERATION, RELIEF_CONTRAST, TINT_CONTRAST = 2.8, 1.15, 1.5
FEATHER = 0.035
RAMP = [(0.0, (24, 108, 100)), (0.2, (58, 145, 84)), (0.4, (154, 191, 68)), (0.58, (230, 204, 68)), (0.75, (223, 146, 55)), (0.9, (193, 84, 62)), (1.0, (138, 46, 66))]
INTERVALS = [1.0, 2.0, 2.5, 5.0, 10.0, 20.0, 25.0, 50.0, 100.0]


def along_rows() -> WindowSpec:
    return Window.partitionBy("r").orderBy("c")


def along_columns() -> WindowSpec:
    return Window.partitionBy("c").orderBy("r")


def stencil(dem: DataFrame) -> DataFrame:
    """The 3x3 surroundings (nw n ne w z e sw s se) of each cell; beyond an edge the edge cell counts.

    One window along rows makes (west, here, east), one along columns takes that triple from above and below.
    """
    beside = dem.withColumn("t", F.struct(F.coalesce(F.lag("z").over(along_rows()), "z").alias("w"), F.col("z").alias("h"), F.coalesce(F.lead("z").over(along_rows()), "z").alias("e")))
    around = beside.withColumns({"up": F.coalesce(F.lag("t").over(along_columns()), "t"), "down": F.coalesce(F.lead("t").over(along_columns()), "t")})
    names = {"nw": "up.w", "n": "up.h", "ne": "up.e", "w": "t.w", "e": "t.e", "sw": "down.w", "s": "down.h", "se": "down.e"}
    return around.select("r", "c", "z", *(F.col(v).alias(k) for k, v in names.items()))


def smooth(dem: DataFrame, passes: int = 1) -> DataFrame:
    """[1 2 1] / 4 along rows, then along columns, as often as asked."""
    for _ in range(passes):
        for w in (along_rows(), along_columns()):
            dem = dem.select("r", "c", ((F.coalesce(F.lag("z").over(w), "z") + 2 * F.col("z") + F.coalesce(F.lead("z").over(w), "z")) / 4).alias("z"))
    return dem


def horn_slope(dem: DataFrame, north_south: float, east_west: float | Column) -> DataFrame:
    """slope in degrees by Horn's gradient over cells of that many metres."""
    col = F.col
    dx = ((col("ne") + 2 * col("e") + col("se")) - (col("nw") + 2 * col("w") + col("sw"))) / (8 * east_west)
    dy = ((col("sw") + 2 * col("s") + col("se")) - (col("nw") + 2 * col("n") + col("ne"))) / (8 * north_south)
    return stencil(dem).select("r", "c", (F.atan(F.hypot(dx, dy)) * 180 / math.pi).alias("slope"))


def ruggedness(dem: DataFrame) -> DataFrame:
    """Mean absolute difference to the eight neighbours."""
    total = sum((F.abs(F.col(n) - F.col("z")) for n in ("nw", "n", "ne", "w", "e", "sw", "s", "se")), F.lit(0.0))
    return stencil(dem).select("r", "c", (total / 8).alias("ruggedness"))


def extent(dem: DataFrame) -> DataFrame:
    """One row: rows, columns, low, high; a raster without finite heights has 0 for both."""
    finite = F.when(~F.isnan("z") & (F.abs("z") != float("inf")), F.col("z"))
    return dem.agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"), F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))


def tiles(cells: DataFrame, of: list[str] | None = None) -> DataFrame:
    """of, tile_r, tile_c, codes, heights: the raster in squares of TILE cells, each with one more row and column of its neighbours.

    codes are the places in the square of the cells that exist, heights theirs. `of` names columns that tell several rasters apart.
    """
    over, beside = F.floor(F.col("r") / TILE), F.floor(F.col("c") / TILE)
    place = lambda dr, dc: F.struct((over - dr).alias("tile_r"), (beside - dc).alias("tile_c"), ((F.col("r") - (over - dr) * TILE) * (TILE + 1) + F.col("c") - (beside - dc) * TILE).cast("int").alias("code"))
    top, left = F.col("r") % TILE == 0, F.col("c") % TILE == 0
    places = F.filter(F.array(place(0, 0), F.when(top, place(1, 0)), F.when(left, place(0, 1)), F.when(top & left, place(1, 1))), lambda x: x.isNotNull())
    dealt = cells.select(*(of or []), "z", F.inline(places))
    squares = dealt.groupBy(*(of or []), "tile_r", "tile_c").agg(F.collect_list(F.struct("code", "z")).alias("cells"))  # at most (TILE + 1) squared
    return squares.select(*(of or []), "tile_r", "tile_c", F.col("cells.code").alias("codes"), F.col("cells.z").alias("heights"))


def squares(cells: DataFrame, measures: list[str]) -> DataFrame:
    """tile_r, tile_c, cells: the raster in squares as in tiles(), a struct of measures at each place of a square, null where there is no cell."""
    named = tiles(cells.select("r", "c", F.struct(*measures).alias("z")))
    return named.select("tile_r", "tile_c", F.transform(F.sequence(F.lit(0), F.lit((TILE + 1) ** 2 - 1)), lambda k: F.get("heights", (F.array_position("codes", k) - 1).cast("int"))).alias("cells"))


def between_cells(points: DataFrame, cells: DataFrame, of: list[str] | None = None) -> DataFrame:
    """points (_y, _x within their raster, _rows, _columns of it) with z, the bilinear height.

    One join on the raster's squares: a point finds its four cells in the square of its corner. A point that needs a cell that is not there has no height.
    """
    r0, c0 = F.floor("_y"), F.floor("_x")
    cut = points.withColumns({"_r": r0, "_c": c0, "tile_r": F.floor(r0 / TILE), "tile_c": F.floor(c0 / TILE)})
    found = cut.join(tiles(cells, of), [*(of or []), "tile_r", "tile_c"], "left")
    fr, fc = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    down, right = F.least(F.col("_r") + 1, F.col("_rows") - 1), F.least(F.col("_c") + 1, F.col("_columns") - 1)

    def part(r: Column, c: Column, weight: Column) -> Column:
        code = ((r - F.col("tile_r") * TILE) * (TILE + 1) + c - F.col("tile_c") * TILE).cast("int")
        height = F.get("heights", (F.array_position("codes", code) - 1).cast("int"))
        return F.when(weight == 0, F.lit(0.0)).otherwise(height * weight)

    z = part(F.col("_r"), F.col("_c"), (1 - fc) * (1 - fr)) + part(F.col("_r"), right, fc * (1 - fr)) + part(down, F.col("_c"), (1 - fc) * fr) + part(down, right, fc * fr)
    return found.withColumn("z", z).select(*points.columns, "z")


def sample(points: DataFrame, dem: DataFrame, key: list[str], north: float, west: float, lat_step: float, lng_step: float) -> DataFrame:
    """key, z: bilinear heights at points (lat, lng), clamped to the raster; null where a cell is missing."""
    size = F.broadcast(extent(dem).select(F.col("rows").alias("_rows"), F.col("columns").alias("_columns")))  # one row
    placed = points.crossJoin(size).select(
        *key, "_rows", "_columns",
        clamp((F.lit(north) - F.col("lat")) / lat_step, F.lit(0.0), F.col("_rows") - 1.0).alias("_y"),
        clamp((F.col("lng") - F.lit(west)) / lng_step, F.lit(0.0), F.col("_columns") - 1.0).alias("_x"),
    )
    return between_cells(placed, dem).select(*key, "z")


def cell_of(lat: Column, lng: Column, north: float, west: float, lat_step: float, lng_step: float, rows: Column, columns: Column) -> tuple[Column, Column]:
    """The nearest cell, clamped to the grid."""
    return clamp(js_round((F.lit(north) - lat) / lat_step), F.lit(0), rows - 1), clamp(js_round((lng - F.lit(west)) / lng_step), F.lit(0), columns - 1)


def slope_by_cell(dem: DataFrame, factor: int, north_south: float, east_west: float) -> DataFrame:
    """cell_r, cell_c, mean_slope, max_slope of a routing grid whose step is `factor` native steps; every native sample goes to its nearest cell."""
    size = F.broadcast(extent(dem).select((F.ceil((F.col("rows") - 1) / factor) + 1).alias("cells_r"), (F.ceil((F.col("columns") - 1) / factor) + 1).alias("cells_c")))  # one row
    dealt = horn_slope(dem, north_south, east_west).crossJoin(size).select(
        F.least(js_round(F.col("r") / factor), F.col("cells_r") - 1).alias("cell_r"), F.least(js_round(F.col("c") / factor), F.col("cells_c") - 1).alias("cell_c"), "slope"
    )
    return dealt.groupBy("cell_r", "cell_c").agg(F.avg("slope").alias("mean_slope"), F.max("slope").alias("max_slope"))


def terrain(dem: DataFrame, place: tuple, native: tuple[float, float], grid: tuple, rows: int, columns: int, cell: tuple[float, float], lines: DataFrame) -> DataFrame:
    """r, c, z, risk, mean_slope, max_slope, ruggedness of every cell of a routing grid, in one row a cell.

    place and native (metres north-south and east-west) are the survey's, grid and cell those of the routing grid. A cell
    takes the mean and the steepest of the survey's slopes nearest to it; one that none is nearest to takes the slope of the routing grid itself.
    """
    spark, (north, west, lat_step, lng_step) = dem.sparkSession, grid
    cells = spark.range(rows).withColumnRenamed("id", "r").crossJoin(spark.range(columns).withColumnRenamed("id", "c"))  # the grid itself
    at = cells.select(F.col("r").alias("cell_r"), F.col("c").alias("cell_c"), (F.lit(north) - F.col("r") * lat_step).alias("lat"), (F.lit(west) + F.col("c") * lng_step).alias("lng"))
    heights = sample(at, dem, ["cell_r", "cell_c"], *place).withColumnsRenamed({"cell_r": "r", "cell_c": "c"})
    lat, lng = F.lit(place[0]) - F.col("r") * place[2], F.lit(place[1]) + F.col("c") * place[3]
    inside = lat.between(north - (rows - 1) * lat_step, north) & lng.between(west, west + (columns - 1) * lng_step)
    near = cell_of(lat, lng, *grid, F.lit(rows), F.lit(columns))
    own = horn_slope(dem, *native).where(inside).groupBy(near[0].cast("long").alias("r"), near[1].cast("long").alias("c")).agg(F.avg("slope").alias("mean"), F.max("slope").alias("most"))
    risk = water_risk(lines, rows, columns, *grid, min(cell)).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "risk")
    joined = heights.join(horn_slope(heights, *cell), ["r", "c"]).join(ruggedness(heights), ["r", "c"]).join(own, ["r", "c"], "left").join(risk, ["r", "c"], "left")
    return joined.select("r", "c", "z", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("mean", "slope").alias("mean_slope"), F.coalesce("most", "slope").alias("max_slope"), "ruggedness")


def water_risk(lines: DataFrame, rows: int | Column, columns: int | Column, north: float, west: float, lat_step: float, lng_step: float, cell_meters: float) -> DataFrame:
    """r, c, risk of the cells within reach of a watercourse: lines are sampled, each sample stamps its window, the greatest stamp counts."""
    step, radius = max(4.0, cell_meters / 2), math.ceil(WATER_REACH / cell_meters)
    steps = F.greatest(F.lit(1), F.ceil(geo.distance(geo.at("a"), geo.at("b")) / step)).cast("int")
    along = lines.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    p = geo.interpolate(geo.at("a"), geo.at("b"), F.col("k") / F.col("steps"))
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    near = along.select(p.lat.alias("lat"), p.lng.alias("lng")).withColumn("dr", F.explode(offsets)).withColumn("dc", F.explode(offsets))
    placed = near.withColumns({"r": js_round((F.lit(north) - F.col("lat")) / lat_step) + F.col("dr"), "c": js_round((F.col("lng") - F.lit(west)) / lng_step) + F.col("dc")})
    inside = placed.where((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < columns))
    center = geo.Point(F.lit(north) - F.col("r") * lat_step, F.lit(west) + F.col("c") * lng_step)
    value = clamp(1 - geo.distance(geo.Point(F.col("lat"), F.col("lng")), center) / WATER_REACH, F.lit(0.0), F.lit(1.0))
    return inside.groupBy("r", "c").agg(F.max(value).alias("risk"))


def suggest_interval(relief: Column) -> Column:
    """The first interval that draws at most 22 lines, else 200."""
    fits = F.filter(F.array(*map(F.lit, INTERVALS)), lambda i: relief / i <= 22)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(200.0))


def hillshade(dem: DataFrame, north_south: float, east_west: float) -> DataFrame:
    """grey, 0 to 255: central differences, edges clamped."""
    around = stencil(dem)
    dx = (F.col("e") - F.col("w")) / (2 * east_west) * RELIEF_EXAGGERATION
    dy = (F.col("s") - F.col("n")) / (2 * north_south) * RELIEF_EXAGGERATION
    slope, aspect = F.atan(F.hypot(dx, dy)), F.atan2(dy, -dx)
    shade = F.greatest(F.lit(0.0), math.sin(SUN_ALTITUDE) * F.cos(slope) + math.cos(SUN_ALTITUDE) * F.sin(slope) * F.cos(F.lit(SUN_AZIMUTH) - aspect))
    return around.select("r", "c", (clamp(0.5 + (shade - math.sin(SUN_ALTITUDE)) * RELIEF_CONTRAST, F.lit(0.0), F.lit(1.0)) * 255).alias("grey"))


def tint(dem: DataFrame, low: Column, high: Column) -> DataFrame:
    """red, green, blue of each cell between low and high."""
    position = clamp(0.5 + ((F.col("z") - low) / F.greatest(high - low, F.lit(1.0)) - 0.5) * TINT_CONTRAST, F.lit(0.0), F.lit(1.0))
    rows = dem.withColumn("position", position)
    colors = []
    for k, name in enumerate(("red", "green", "blue")):
        c = F
        for (s0, c0), (s1, c1) in zip(RAMP[:-1], RAMP[1:], strict=True):
            c = c.when(F.col("position") <= s1, c0[k] + (c1[k] - c0[k]) * ((F.col("position") - s0) / (s1 - s0)))
        colors.append(c.otherwise(float(RAMP[-1][1][k])).alias(name))
    return rows.select("r", "c", *colors)


def marching_squares(dem: DataFrame, interval: float) -> DataFrame:
    """level, r, c, part, a_r, a_c, b_r, b_c: contour segments in grid units, for every level k * interval within a cell's heights."""
    east = dem.withColumns({"ne": F.lead("z").over(along_rows())}).withColumn("t", F.struct("z", "ne"))
    cells = east.withColumn("u", F.lead("t").over(along_columns())).where("ne IS NOT NULL AND u IS NOT NULL").select("r", "c", F.col("z").alias("nw"), "ne", F.col("u.z").alias("sw"), F.col("u.ne").alias("se"))
    low, high = F.least("nw", "ne", "sw", "se"), F.greatest("nw", "ne", "sw", "se")
    first, last = F.floor(low / interval) + 1, F.floor(high / interval)  # at the lowest corner's own level the code is 15
    leveled = cells.where(last >= first).withColumn("k", F.explode(F.sequence(first, last))).withColumn("level", F.col("k") * F.lit(interval)).drop("k")
    bit = lambda n, b: F.when(F.col(n) >= F.col("level"), b).otherwise(0)
    coded = leveled.withColumn("code", bit("nw", 8).bitwiseOR(bit("ne", 4)).bitwiseOR(bit("se", 2)).bitwiseOR(bit("sw", 1))).where("code NOT IN (0, 15)")
    part = lambda a, b: (F.col("level") - F.col(a)) / (F.col(b) - F.col(a))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    ends = {"top": (r, c + part("nw", "ne")), "bottom": (r + 1, c + part("sw", "se")), "left": (r + part("nw", "sw"), c), "right": (r + part("ne", "se"), c + 1)}
    seg = lambda a, b: F.struct(ends[a][0].alias("a_r"), ends[a][1].alias("a_c"), ends[b][0].alias("b_r"), ends[b][1].alias("b_c"))
    code = F.col("code")
    middle = (F.col("nw") + F.col("ne") + F.col("sw") + F.col("se")) / 4
    flipped = F.when(code == 5, middle < F.col("level")).otherwise(middle >= F.col("level"))
    single = (
        F.when(code.isin(1, 14), F.array(seg("left", "bottom")))
        .when(code.isin(2, 13), F.array(seg("bottom", "right")))
        .when(code.isin(3, 12), F.array(seg("left", "right")))
        .when(code.isin(4, 11), F.array(seg("top", "right")))
        .when(code.isin(6, 9), F.array(seg("top", "bottom")))
        .when(code.isin(7, 8), F.array(seg("left", "top")))
        .when(flipped, F.array(seg("left", "top"), seg("bottom", "right")))
        .otherwise(F.array(seg("left", "bottom"), seg("top", "right")))
    )
    return coded.select("level", "r", "c", F.posexplode(single).alias("part", "s")).select("level", "r", "c", "part", "s.*")


def top_level() -> Column:
    """The largest level whose nodes fit into a raster of `rows` and `columns`."""
    return F.floor(F.log(float(FAN), F.greatest(F.col("rows"), F.col("columns"), F.lit(1)))).cast("int")


def pyramid(dem: DataFrame, size: DataFrame) -> DataFrame:
    """level, r, c, lo, hi: the least and greatest height of squares of FAN ** level cells, from the cells themselves (level 0) up to the raster's size.

    size is its extent. Cells are summed up once; all further levels come from the first, of 1 / FAN ** 2 as many rows.
    """
    cells = dem.select(F.lit(0).alias("level"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").alias("lo"), F.col("z").alias("hi"))
    over = lambda at: F.floor(F.col(at) / FAN).alias(at)
    low_high = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    first = cells.groupBy(over("r"), over("c")).agg(*low_high)
    up = lambda at: F.floor(F.col(at) / F.pow(F.lit(FAN), F.col("level") - 1)).alias(at)
    dealt = first.crossJoin(size.select(top_level().alias("top"))).where("top > 1").withColumn("level", F.explode(F.sequence(F.lit(2), "top")))  # one row
    upper = dealt.select("level", up("r"), up("c"), "lo", "hi").groupBy("level", "r", "c").agg(*low_high)
    return cells.union(first.select(F.lit(1).alias("level"), "r", "c", "lo", "hi")).union(upper)


def whole_nodes(boxes: DataFrame) -> DataFrame:
    """boxes (r0, r1, c0, c1, both ends within, and top) with the nodes (level, r, c) of a pyramid that make each up, each cell in one node.

    A level gives the nodes inside the box that the next level leaves, a frame of less than FAN nodes at each side, so the rows of a box
    grow with its perimeter. A box without a cell keeps one row, with null nodes.
    """
    levels = boxes.withColumn("level", F.explode_outer(F.sequence(F.lit(0), "top")))
    side, above = F.pow(F.lit(FAN), F.col("level")), F.pow(F.lit(FAN), F.col("level") + 1)
    inside = {}
    for at in ("r", "c"):
        inside |= {f"_{at}0": F.ceil(F.col(f"{at}0") / side), f"_{at}1": F.floor((F.col(f"{at}1") + 1) / side)}
        inside |= {f"_{at}2": F.ceil(F.col(f"{at}0") / above) * FAN, f"_{at}3": F.floor((F.col(f"{at}1") + 1) / above) * FAN}
    cut = levels.withColumns(inside).withColumn("_next", (F.col("level") < F.col("top")) & (F.col("_r2") < F.col("_r3")) & (F.col("_c2") < F.col("_c3")))
    none = F.array().cast("array<bigint>")
    upto = lambda a, b: F.when(F.col(a) < F.col(b), F.sequence(F.col(a), F.col(b) - 1)).otherwise(none)
    lines = cut.withColumn("r", F.explode_outer(upto("_r0", "_r1")))
    covered = F.col("_next") & (F.col("r") >= F.col("_r2")) & (F.col("r") < F.col("_r3"))
    across = F.when(F.col("r").isNull(), none).when(covered, F.concat(upto("_c0", "_c2"), upto("_c3", "_c1"))).otherwise(upto("_c0", "_c1"))
    nodes = lines.withColumn("c", F.explode_outer(across))
    return nodes.where(F.col("c").isNotNull() | (F.col("r").isNull() & F.coalesce(F.col("level") == 0, F.lit(True)))).select(*boxes.columns, "level", "r", "c")


def local_range(dem: DataFrame, box: DataFrame, north: float, west: float, lat_step: float, lng_step: float, buffer: float = 150.0) -> DataFrame:
    """key columns of box (n, s, e, w) with low and high of the heights around it; a span under one metre counts as the whole raster's.

    A box is cut into whole nodes of a min/max pyramid and joined to them. A box with a null bound, or over cells that are not there, has the whole raster's range.
    """
    degree = 111_320.0
    size = extent(dem)
    whole = F.broadcast(size)  # one row
    pad_lat, pad_lng = F.lit(buffer / degree), buffer / (degree * F.cos(geo.radians((F.col("n") + F.col("s")) / 2)))
    row = lambda lat: clamp(js_round((F.lit(north) - lat) / lat_step), F.lit(0), F.col("rows") - 1)
    column = lambda lng: clamp(js_round((lng - F.lit(west)) / lng_step), F.lit(0), F.col("columns") - 1)
    bounded = F.col("n").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull() & F.col("w").isNotNull()  # clamp passes over nulls
    asked = box.crossJoin(whole).withColumns({"r0": row(F.col("n") + pad_lat), "r1": row(F.col("s") - pad_lat), "c0": column(F.col("w") - pad_lng), "c1": column(F.col("e") + pad_lng), "top": F.when(bounded, top_level())})
    keys = [c for c in box.columns if c not in ("n", "s", "e", "w")]
    wanted = whole_nodes(asked.select(*keys, F.col("low").alias("low_all"), F.col("high").alias("high_all"), "r0", "r1", "c0", "c1", "top"))
    found = wanted.join(pyramid(dem, whole), ["level", "r", "c"], "left").groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("low_all").alias("low_all"), F.first("high_all").alias("high_all"))
    spans = F.coalesce(F.col("hi") - F.col("lo") >= 1, F.lit(False))
    return found.select(*keys, F.when(spans, F.col("lo")).otherwise(F.col("low_all")).alias("low"), F.when(spans, F.col("hi")).otherwise(F.col("high_all")).alias("high"))


def rendered(dem: DataFrame, rows: int, columns: int, north: float, west: float, lat_step: float, lng_step: float, scale: float = 2.0, most: int = 1400, elevation_range: tuple[float, float] | None = None, hypsometric: bool = False) -> DataFrame:
    """y, x, red, green, blue, alpha of a picture of the raster, up to `most` pixels along each side; channels 0 to 255, colours not yet rounded.

    Each pixel takes the height at its middle. Grey relief, or the tint between elevation_range (the raster's own, if none). The border fades.
    """
    width, height = min(most, math.floor(columns * scale + 0.5)), min(most, math.floor(rows * scale + 0.5))
    spark, down, across = dem.sparkSession, (rows - 1) * lat_step, (columns - 1) * lng_step
    pixels = spark.range(height).withColumnRenamed("id", "y").crossJoin(spark.range(width).withColumnRenamed("id", "x"))  # the picture itself
    middle = pixels.select("y", "x", (F.lit(north) - (F.col("y") + 0.5) / height * down).alias("lat"), (F.lit(west) + (F.col("x") + 0.5) / width * across).alias("lng"))
    heights = sample(middle, dem, ["y", "x"], north, west, lat_step, lng_step).withColumnsRenamed({"y": "r", "x": "c"})
    if hypsometric:
        if elevation_range:
            colored = tint(heights, F.lit(elevation_range[0]), F.lit(elevation_range[1]))
        else:
            colored = tint(heights.crossJoin(F.broadcast(extent(dem).select("low", "high"))), F.col("low"), F.col("high"))  # one row
    else:
        pixel = lat_step * rows * 111_132.0 / height, lng_step * columns * 111_132.0 * math.cos(math.radians(north)) / width
        colored = hillshade(heights, *pixel).select("r", "c", *(F.col("grey").alias(k) for k in ("red", "green", "blue")))
    fade = lambda at, size: F.least(at / max(1.0, size * FEATHER), (size - 1 - at) / max(1.0, size * FEATHER))
    edge = F.least(fade(F.col("c"), width), fade(F.col("r"), height), F.lit(1.0))
    return colored.select(F.col("r").alias("y"), F.col("c").alias("x"), "red", "green", "blue", js_round(255 * edge).alias("alpha"))
