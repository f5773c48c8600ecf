"""Heights from several rasters at once: web map tiles in pixel space, and survey grids that overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import geo
from crestline.functions.numeric import clamp
from crestline.operators import raster
from crestline.sources.elevation import decimetres, fill_gaps

DEGREE = 111_320.0
BLOCK = 1024.0  # metres; a survey grid is looked up by the blocks that it touches


def pixels(tiles: DataFrame, size: int = 256) -> DataFrame:
    """r, c, z on the whole map's pixels of tiles (x, y, r, c, red, green, blue)."""
    return tiles.select((F.col("y") * size + F.col("r")).alias("r"), (F.col("x") * size + F.col("c")).alias("c"), geo.terrarium_height(F.col("red"), F.col("green"), F.col("blue")).alias("z"))


def tile_range(box: dict[str, float], zoom: int) -> tuple[int, int, int, int]:
    """first and last tile column, first and last tile row of a box (north, south, west, east)."""
    column = lambda lng: math.floor((lng + 180) / 360 * 2**zoom)
    row = lambda lat: math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**zoom)
    return column(box["west"]), column(box["east"]), row(box["north"]), row(box["south"])


def sample_tiles(points: DataFrame, tiles: DataFrame, box: dict[str, float], zoom: int, size: int = 256) -> DataFrame:
    """points (lat, lng) with z, bilinear in pixel space and clamped to the tiles that cover the box.

    A tile that is not there leaves no height, so a flat map is never taken for a measured one.
    """
    x0, x1, y0, y1 = tile_range(box, zoom)
    covering = tiles.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    own = pixels(covering, size).select((F.col("r") - y0 * size).alias("r"), (F.col("c") - x0 * size).alias("c"), "z")
    rows, columns = (y1 - y0 + 1) * size, (x1 - x0 + 1) * size
    y = clamp(geo.tile_y(F.col("lat"), zoom) * size - y0 * size, F.lit(0.0), F.lit(rows - 1.0))
    x = clamp(geo.tile_x(F.col("lng"), zoom) * size - x0 * size, F.lit(0.0), F.lit(columns - 1.0))
    placed = points.withColumns({"_y": y, "_x": x, "_rows": F.lit(rows), "_columns": F.lit(columns)})
    return raster.between_cells(placed, own).drop("_y", "_x", "_rows", "_columns")


def places(spark: SparkSession, box: dict[str, float], rows: int, columns: int) -> DataFrame:
    """r, c, lat, lng of a regular grid over the box; both edges are in it."""
    down, across = (box["north"] - box["south"]) / (rows - 1), (box["east"] - box["west"]) / (columns - 1)
    cells = spark.range(rows).withColumnRenamed("id", "r").crossJoin(spark.range(columns).withColumnRenamed("id", "c"))  # the grid itself
    return cells.select("r", "c", (F.lit(box["north"]) - F.col("r") * down).alias("lat"), (F.lit(box["west"]) + F.col("c") * across).alias("lng"))


def grid_size(box: dict[str, float], spacing: float, degree: float) -> tuple[int, int]:
    """rows, columns of a grid whose cells are about so many metres apart; at least two each."""
    middle = math.radians((box["north"] + box["south"]) / 2)
    down, across = (box["north"] - box["south"]) * degree, (box["east"] - box["west"]) * degree * math.cos(middle)
    return max(2, math.floor(down / spacing + 0.5) + 1), max(2, math.floor(across / spacing + 0.5) + 1)


def grid_from_tiles(tiles: DataFrame, box: dict[str, float], zoom: int = 13, spacing: float = 12.0, size: int = 256) -> DataFrame:
    """r, c, z of a grid over the box from height tiles: spacing at least four metres, 16 to 900 rows and columns."""
    rows, columns = (min(900, max(16, n)) for n in grid_size(box, max(4.0, spacing), 111_132.0))
    return sample_tiles(places(tiles.sparkSession, box, rows, columns), tiles, box, zoom, size).select("r", "c", "z")


def flat(spark: SparkSession) -> DataFrame:
    """r, c, z of two by two zeros: what stands in for heights where none can be read."""
    return spark.range(4).select(F.floor(F.col("id") / 2).alias("r"), (F.col("id") % 2).alias("c"), F.lit(0.0).alias("z"))


def survey_grids(cells: DataFrame) -> DataFrame:
    """file, rows, columns, dx, dy and the outer edges of the grids that read_ascii_grid gives."""
    half = F.lit(0.5)
    size = cells.groupBy("file").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"), *(F.min(k).alias(k) for k in ("west", "south", "dx", "dy")))
    return size.select("file", "rows", "columns", "dx", "dy", (F.col("west") - half * F.col("dx")).alias("west"), (F.col("south") - half * F.col("dy")).alias("south"))


def sample_surveys(points: DataFrame, key: list[str], grids: DataFrame, cells: DataFrame, order: Column | None = None) -> DataFrame:
    """key, file, z at points (px, py): from the first grid by order (its file name, if none) that holds the point; both null where none does.

    grids: file, rows, columns, dx, dy, west, south (outer edges); cells: file, r, c, z and, if there is one, nodata, which counts as no height.
    Points meet only the grids of their own block, so the join grows with points and not with points times grids.
    """
    touched = lambda low, high: F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK)))
    east, north = F.col("west") + F.col("columns") * F.col("dx"), F.col("south") + F.col("rows") * F.col("dy")
    lookup = grids.select("*", (F.col("file") if order is None else order).alias("place")).withColumn("block_x", touched(F.col("west"), east)).withColumn("block_y", touched(F.col("south"), north))
    at = points.select(*key, "px", "py", F.floor(F.col("px") / BLOCK).alias("block_x"), F.floor(F.col("py") / BLOCK).alias("block_y"))
    col, row = (F.col("px") - F.col("west")) / F.col("dx") - 0.5, F.col("rows") - 0.5 - (F.col("py") - F.col("south")) / F.col("dy")
    meets = at.join(lookup, ["block_x", "block_y"]).withColumns({"col": col, "row": row})
    inside = meets.where(F.col("col").between(-0.5, F.col("columns") - 0.5) & F.col("row").between(-0.5, F.col("rows") - 0.5))
    first = inside.groupBy(*key).agg(F.min(F.struct("place", "file", "rows", "columns", "row", "col")).alias("g"))
    y, x = clamp(F.col("g.row"), F.lit(0.0), F.col("g.rows") - 1.0), clamp(F.col("g.col"), F.lit(0.0), F.col("g.columns") - 1.0)
    placed = first.select(*key, "g.file", F.col("g.rows").alias("_rows"), F.col("g.columns").alias("_columns"), y.alias("_y"), x.alias("_x"))
    known = cells.withColumn("z", F.when(F.col("nodata").isNull() | (F.col("z") != F.col("nodata")), F.col("z"))) if "nodata" in cells.columns else cells
    heights = raster.between_cells(placed, known.select("file", "r", "c", "z"), ["file"]).select(*key, "file", "z")
    return points.select(*key).join(heights, key, "left")


def resampled(grids: DataFrame, cells: DataFrame, box: dict[str, float], spacing: float) -> DataFrame:
    """r, c, z, decimetres of a regular grid of degrees over overlapping survey grids in EPSG:2180; cells outside all of them take the nearest height."""
    spark = cells.sparkSession
    projected = places(spark, box, *grid_size(box, spacing, DEGREE)).withColumn("p", geo.to_poland_1992(geo.Point(F.col("lat"), F.col("lng"))))
    heights = sample_surveys(projected.select("r", "c", F.col("p.x").alias("px"), F.col("p.y").alias("py")), ["r", "c"], grids, cells)
    whole = fill_gaps(heights.select("r", "c", (decimetres(F.col("z")) / 10).alias("z")))
    return whole.select("r", "c", "z", decimetres(F.col("z")).alias("decimetres"))
