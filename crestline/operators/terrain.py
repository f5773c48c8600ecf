"""Terrain kept as a table of tiles, and what it is like at points.

A tile holds the measures of a square of cells and of one more row and column of its neighbours, as arrays
in which a cell's place follows from its row and column. The table is bucketed by tile, so points
are dealt to it and the raster itself is not moved again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.numeric import clamp

from . import raster

SIDE = 32
MEASURES = ("z", "slope", "ruggedness", "risk")


class TerrainTiles:
    """A stored terrain: open it by its name, or write one with create()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        about = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        self.rows, self.columns = (int(about[f"terrain.{k}"]) for k in ("rows", "columns"))
        self.place = tuple(float(about[f"terrain.{k}"]) for k in ("north", "west", "lat_step", "lng_step"))

    @classmethod
    def create(cls, cells: DataFrame, place: tuple, name: str, path: str, buckets: int | None = None) -> TerrainTiles:
        """cells: r, c and MEASURES, null or left out where unknown; place: north, west, lat_step, lng_step. The tiles go to path."""
        spark = cells.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        size = cells.agg(F.coalesce(F.max("r") + 1, F.lit(0)).alias("rows"), F.coalesce(F.max("c") + 1, F.lit(0)).alias("columns")).first()
        about = {"rows": size.rows, "columns": size.columns} | dict(zip(("north", "west", "lat_step", "lng_step"), place, strict=True))
        listed = ", ".join(f"'terrain.{k}' = '{v!r}'" for k, v in about.items())
        arrays = ", ".join(f"{m} ARRAY<DOUBLE>" for m in MEASURES)
        spark.sql(f"CREATE TABLE {name} (tile BIGINT, {arrays}) USING parquet CLUSTERED BY (tile) SORTED BY (tile) INTO {buckets} BUCKETS LOCATION '{path}' TBLPROPERTIES ({listed})")
        tiled(cells).repartition(buckets, "tile").write.insertInto(name)
        return cls(spark, name)

    def at(self, points: DataFrame, key: list[str]) -> DataFrame:
        """key, z (bilinear), and slope, ruggedness and risk of the nearest cell, at points (lat, lng) clamped to the raster; null where a cell is missing."""
        north, west, lat_step, lng_step = self.place
        y = clamp((F.lit(north) - F.col("lat")) / lat_step, F.lit(0.0), F.lit(self.rows - 1.0))
        x = clamp((F.col("lng") - F.lit(west)) / lng_step, F.lit(0.0), F.lit(self.columns - 1.0))
        near = raster.cell_of(F.col("lat"), F.col("lng"), *self.place, F.lit(self.rows), F.lit(self.columns))
        placed = points.select(*key, y.alias("_y"), x.alias("_x"), *(n.cast("long").alias(k) for n, k in zip(near, ("_nr", "_nc"), strict=True)))
        placed = placed.withColumns({"_r": F.floor("_y"), "_c": F.floor("_x")}).withColumn("tile", tile_key(F.floor(F.col("_r") / SIDE), F.floor(F.col("_c") / SIDE)))
        met = placed.join(self.spark.table(self.name).hint("merge"), "tile", "left")
        row, column = F.col("_r") - F.col("_r") % SIDE, F.col("_c") - F.col("_c") % SIDE

        def cell(measure: str, r: Column, c: Column) -> Column:
            return F.get(measure, ((r - row) * (SIDE + 1) + c - column).cast("int"))

        def part(r: Column, c: Column, weight: Column) -> Column:
            return F.when(weight == 0, F.lit(0.0)).otherwise(cell("z", r, c) * weight)

        fr, fc = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
        r0, c0 = F.col("_r"), F.col("_c")
        z = part(r0, c0, (1 - fc) * (1 - fr)) + part(r0, c0 + 1, fc * (1 - fr)) + part(r0 + 1, c0, (1 - fc) * fr) + part(r0 + 1, c0 + 1, fc * fr)  # at the far edges these weights are 0
        return met.select(*key, z.alias("z"), *(cell(m, F.col("_nr"), F.col("_nc")).alias(m) for m in MEASURES[1:]))


def tile_key(tile_r: Column, tile_c: Column) -> Column:
    return F.shiftleft(tile_r.cast("long"), 32) + tile_c


def tiled(cells: DataFrame) -> DataFrame:
    """tile and an array of (SIDE + 1) squared values for each measure, null where a cell is unknown."""
    over, beside = F.floor(F.col("r") / SIDE), F.floor(F.col("c") / SIDE)
    place = lambda dr, dc: F.struct(tile_key(over - dr, beside - dc).alias("tile"), ((F.col("r") - (over - dr) * SIDE) * (SIDE + 1) + F.col("c") - (beside - dc) * SIDE).alias("code"))
    top, left = (F.col("r") % SIDE == 0) & (F.col("r") > 0), (F.col("c") % SIDE == 0) & (F.col("c") > 0)
    places = F.array_compact(F.array(place(0, 0), F.when(top, place(1, 0)), F.when(left, place(0, 1)), F.when(top & left, place(1, 1))))
    dealt = cells.select(*MEASURES, F.inline(places))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        made = {"tile": [rows["tile"].iloc[0]]}
        for m in MEASURES:
            values = np.full((SIDE + 1) ** 2, None, object)
            known = rows[rows[m].notna()]
            values[known["code"].to_numpy()] = known[m].to_numpy()
            made[m] = [values]
        return pd.DataFrame(made)

    return dealt.groupBy("tile").applyInPandas(whole, "tile long, " + ", ".join(f"{m} array<double>" for m in MEASURES))
