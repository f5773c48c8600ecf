"""Elevation rasters from text grids, packed snapshots and height tiles, in long form (r, c, z)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.functions.numeric import js_round
from crestline.operators.checkpoints import ensure_checkpoint_dir

TILE = 256
HEIGHTS_VERSION = 1


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """file, r, c, z, west, south, dx, dy, nodata of ESRI text grids; a wrong number of values is an error.

    nodata is carried, not applied.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+").alias("w"))
    named = text.withColumn("n", F.expr("aggregate(sequence(0, 12, 2), 0, (n, k) -> if(n = k AND k < size(w) AND w[k] RLIKE '^[A-Za-z_]+$', n + 2, n))"))
    header = F.map_from_arrays(F.expr("transform(sequence(0, n - 2, 2), k -> lower(w[k]))"), F.expr("transform(sequence(1, n - 1, 2), k -> double(w[k]))"))
    h = named.withColumn("h", header).withColumns({"columns": F.expr("int(h['ncols'])"), "rows": F.expr("int(h['nrows'])")})
    size = F.assert_true(F.size("w") - F.col("n") == F.col("rows") * F.col("columns"), F.lit("wrong number of values"))
    checked = h.where(size.isNull())
    dx, dy = F.expr("coalesce(h['dx'], h['cellsize'])"), F.expr("coalesce(h['dy'], h['cellsize'])")
    west, south = F.expr("coalesce(h['xllcorner'] + {0} / 2, h['xllcenter'])".format("coalesce(h['dx'], h['cellsize'])")), F.expr("coalesce(h['yllcorner'] + {0} / 2, h['yllcenter'])".format("coalesce(h['dy'], h['cellsize'])"))
    cells = checked.select("file", "columns", west.alias("west"), south.alias("south"), dx.alias("dx"), dy.alias("dy"), F.expr("h['nodata_value']").alias("nodata"), F.posexplode(F.expr("slice(w, n + 1, size(w))")).alias("k", "v"))
    return cells.select("file", F.floor(F.col("k") / F.col("columns")).alias("r"), (F.col("k") % F.col("columns")).alias("c"), F.col("v").cast("double").alias("z"), "west", "south", "dx", "dy", "nodata")


def from_packed(rows: DataFrame) -> DataFrame:
    """key, r, c, z of rows (key, columns, data_base64): little-endian 16-bit decimetres, north row first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, columns, data in zip(batch["key"], batch["columns"], batch["data"], strict=True):
                z = np.frombuffer(data, "<i2") / 10.0
                k = np.arange(len(z))
                yield pd.DataFrame({"key": key, "r": k // columns, "c": k % columns, "z": z})

    return rows.select("key", "columns", F.unbase64("data_base64").alias("data")).mapInPandas(run, "key string, r long, c long, z double")


def to_packed(cells: DataFrame, columns: int) -> DataFrame:
    """key, columns, data_base64 of cells (key, r, c, z), one row per raster row block `key`."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["r", "c"])
        return pd.DataFrame({"key": [ordered["key"].iloc[0]], "columns": [columns], "data": [ordered["q"].to_numpy().astype("<i2").tobytes()]})

    packed = cells.withColumn("q", decimetres(F.col("z"))).groupBy("key").applyInPandas(run, "key string, columns int, data binary")
    return packed.select("key", "columns", F.base64("data").alias("data_base64"))


def read_height_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, cells) of whole JSON documents with schemaVersion 1, bounds, rows, columns and dataBase64.

    documents: file, north, south, east, west, rows, columns, source, spacing_meters; cells: key (the file), r, c, z.
    """
    schema = "schemaVersion int, source string, bounds struct<north: double, south: double, east: double, west: double>, rows int, columns int, spacingMeters double, dataBase64 string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    checked = rows.where(F.assert_true(F.col("schemaVersion").eqNullSafe(HEIGHTS_VERSION), F.lit("unknown schema version")).isNull())
    cells = from_packed(checked.select(F.col("file").alias("key"), "columns", F.col("dataBase64").alias("data_base64")))
    return checked.select("file", "bounds.*", "rows", "columns", "source", F.col("spacingMeters").alias("spacing_meters")), cells


def write_height_document(cells: DataFrame, path: str, box: dict[str, float], rows: int, columns: int, spacing: float, source: str) -> None:
    """One document of cells (r, c, z): it is packed as a whole, so it is for areas that a map loads at once; larger rasters stay in Parquet."""
    keyed = cells.select(F.lit("all").alias("key"), "r", "c", "z")
    low_high = cells.agg((js_round(F.min("z") * 10) / 10).alias("minElevationMeters"), (js_round(F.max("z") * 10) / 10).alias("maxElevationMeters"))
    bounds = F.struct(*(F.lit(float(box[k])).alias(k) for k in ("north", "south", "east", "west")))
    document = to_packed(keyed, columns).crossJoin(low_high).select(  # one row each
        F.lit(HEIGHTS_VERSION).alias("schemaVersion"), F.lit(source).alias("source"), bounds.alias("bounds"), F.lit(rows).alias("rows"), "columns",
        F.lit(float(spacing)).alias("spacingMeters"), F.lit("decimetres").alias("unit"), "minElevationMeters", "maxElevationMeters", F.col("data_base64").alias("dataBase64"),
    )
    document.coalesce(1).write.json(path)


def decimetres(z: Column) -> Column:
    return js_round(z * 10).cast("smallint")


def png_pixels(raw: bytes) -> np.ndarray:
    """(rows, columns, channels) of an 8-bit RGB or RGBA PNG without interlace."""
    at, packed = 8, b""
    while at < len(raw):
        (size,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or color not in (2, 6) or interlace:
                raise ValueError("only 8-bit RGB(A) without interlace")
            channels = 3 if color == 2 else 4
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for row in range(height):
        kind, line = lines[row, 0], lines[row, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for k in range(len(line)):
                left = line[k - channels] if k >= channels else 0
                up, corner = int(above[k]), int(above[k - channels]) if k >= channels else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                line[k] = (line[k] + guess) & 255
        above = (line & 255).astype(np.uint8)
        out[row] = above
    return out.reshape(height, width, channels)


def read_height_tiles(spark: SparkSession, path: str) -> DataFrame:
    """x, y, r, c, red, green, blue of tiles .../<x>/<y>.png; heights by functions.geo.terrarium_height."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y, raw in zip(batch["x"], batch["y"], batch["content"], strict=True):
                pixels = png_pixels(raw)
                r, c = np.indices(pixels.shape[:2])
                yield pd.DataFrame({"x": x, "y": y, "r": r.ravel(), "c": c.ravel(), "red": pixels[..., 0].ravel().astype("int32"), "green": pixels[..., 1].ravel().astype("int32"), "blue": pixels[..., 2].ravel().astype("int32")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path)
    tile = files.select(F.regexp_extract("path", r"(\d+)/(\d+)\.png$", 1).cast("long").alias("x"), F.regexp_extract("path", r"(\d+)/(\d+)\.png$", 2).cast("long").alias("y"), "content")
    return tile.mapInPandas(run, "x long, y long, r long, c long, red int, green int, blue int")


def plan_tiles(spark: SparkSession, west: float, south: float, east: float, north: float, most_meters: float = 1100.0) -> DataFrame:
    """tile_r, tile_c, west, south, east, north of a projected extent in boxes of at most so many metres."""
    across, down = max(1, -int(-(east - west) // most_meters)), max(1, -int(-(north - south) // most_meters))
    width, height = (east - west) / across, (north - south) / down
    tiles = spark.range(down).withColumnRenamed("id", "tile_r").crossJoin(spark.range(across).withColumnRenamed("id", "tile_c"))  # both by the extent alone
    return tiles.select("tile_r", "tile_c", (west + F.col("tile_c") * width).alias("west"), (south + F.col("tile_r") * height).alias("south"), (west + (F.col("tile_c") + 1) * width).alias("east"), (south + (F.col("tile_r") + 1) * height).alias("north"))


def ring_distances(upright: np.ndarray) -> np.ndarray:
    """For each place of a row, the least d with a height at most d places to either side and d rows up or down.

    upright: rows to the nearest height in each column, infinite where there is none. A window's least value falls and
    d rises with d, so d is found by bisection over a table of the least values of 1, 2, 4 ... columns.
    """
    n = len(upright)
    least = [upright]
    while 2 << (len(least) - 1) <= n:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    at = np.arange(n)

    def within(d: np.ndarray) -> np.ndarray:
        low, high = np.maximum(at - d, 0), np.minimum(at + d, n - 1) + 1
        level = np.log2(high - low).astype(np.int64)
        out = np.empty(n)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(least[k][low[own]], least[k][high[own] - (1 << k)])
        return out

    finite = upright[np.isfinite(upright)]
    if not len(finite):
        return np.full(n, np.inf)
    low, high = np.zeros(n, np.int64), np.full(n, int(max(n, finite.max())), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        holds = within(middle) <= middle
        low, high = np.where(holds, low, middle + 1), np.where(holds, middle, high)
    return low.astype(float)


def fill_gaps(cells: DataFrame) -> DataFrame:
    """cells (r, c, z, null where unknown) with each gap filled from the nearest ring that has a height, first by row then by column.

    Only measured heights count, so the result does not depend on an order of filling. The distance to the ring comes
    in two passes, along columns by windows and then along each row, so a gap's width does not matter. No height is nearer than
    the ring: its first height is the first of the ring's upper row, its two columns and its lower row, each found by one look-up
    along a row or column. Rows grow with the cells alone. A raster without any height stays as it is.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    known = cells.where("z IS NOT NULL").select("r", "c", "z")
    gaps = cells.where("z IS NULL").select("r", "c")
    sides = F.broadcast(cells.agg(F.min("c").alias("first"), F.max("c").alias("last")))  # one row
    lines = gaps.select("r").distinct().crossJoin(sides).select("r", F.explode(F.sequence("first", "last")).alias("c"))
    row = F.when(F.col("z").isNotNull(), F.col("r"))
    down = Window.partitionBy("c").orderBy("r")
    placed = lines.withColumn("z", F.lit(None).cast("double")).unionByName(known)
    upright = placed.select("r", "c", "z", F.least(F.col("r") - F.max(row).over(down.rangeBetween(Window.unboundedPreceding, 0)), F.min(row).over(down.rangeBetween(0, Window.unboundedFollowing)) - F.col("r")).cast("double").alias("v"))
    wanted = upright.where("z IS NULL").select("r", "c", "v").join(gaps.withColumn("gap", F.lit(True)), ["r", "c"], "left")

    def nearest(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("c")
        line["d"] = ring_distances(line["v"].fillna(np.inf).to_numpy())
        found = line[line["gap"].notna() & np.isfinite(line["d"])]
        return found[["r", "c", "d"]].astype("int64")

    rings = wanted.groupBy("r").applyInPandas(nearest, "r long, c long, d long").checkpoint()
    ask = lambda line, at, upto, along: F.struct(line.alias("line"), at.alias("at"), upto.alias("upto"), F.lit(along).alias("along"))
    r, c, d = F.col("r"), F.col("c"), F.col("d")
    asked = rings.withColumn("q", F.explode(F.array(ask(r - d, c - d, c + d, "row"), ask(r + d, c - d, c + d, "row"), ask(c - d, r - d, r + d, "column"), ask(c + d, r - d, r + d, "column")))).select("r", "c", "q.*")
    heights = known.select(F.col("r").alias("line"), F.col("c").alias("at"), F.lit("row").alias("along"), "z").unionByName(known.select(F.col("c").alias("line"), F.col("r").alias("at"), F.lit("column").alias("along"), "z"))
    ahead = Window.partitionBy("along", "line").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    met = F.min(F.when(F.col("z").isNotNull(), F.struct("at", "z"))).over(ahead)
    found = asked.unionByName(heights, allowMissingColumns=True).withColumn("met", met).where("upto IS NOT NULL AND met.at <= upto")
    place = F.when(F.col("along") == "row", F.struct(F.col("line").alias("nr"), F.col("met.at").alias("nc"))).otherwise(F.struct(F.col("met.at").alias("nr"), F.col("line").alias("nc")))
    filled = found.groupBy("r", "c").agg(F.min_by("met.z", place).alias("near_z"))
    return cells.join(filled, ["r", "c"], "left").select("r", "c", F.coalesce("z", "near_z").alias("z"))
