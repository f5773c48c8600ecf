"""A stored terrain against the raster it was made from."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import raster, terrain

PLACE = (54.5, 18.4, 2.7e-4, 4.6e-4)


def cells(spark, rows, columns, missing=()):
    r = random.Random(rows * columns)
    made = [(y, x, *(r.uniform(0, 90) for _ in terrain.MEASURES)) for y in range(rows) for x in range(columns) if (y, x) not in missing]
    return spark.createDataFrame(made, "r long, c long, z double, slope double, ruggedness double, risk double")


@pytest.mark.parametrize("rows, columns", [(1, 1), (9, 13), (8, 4)])
def test_measures_at_points_equal_those_of_the_raster(spark, tmp_path, monkeypatch, rows, columns):
    monkeypatch.setattr(terrain, "SIDE", 4)
    grid = cells(spark, rows, columns)
    name = f"stored_{rows}_{columns}"
    terrain.TerrainTiles.create(grid, PLACE, name, f"file://{tmp_path}/tiles", 3)
    stored = terrain.TerrainTiles(spark, name)  # opened again by its name
    assert (stored.rows, stored.columns, stored.place) == (rows, columns, PLACE)
    r = random.Random(7)
    spots = [(k, PLACE[0] - r.uniform(-1, rows) * PLACE[2], PLACE[1] + r.uniform(-1, columns) * PLACE[3]) for k in range(200)] + [(1000 + y * 50 + x, PLACE[0] - y * PLACE[2], PLACE[1] + x * PLACE[3]) for y in range(rows) for x in range(columns)]
    points = spark.createDataFrame(spots, "k int, lat double, lng double")
    want = {x.k: x.z for x in raster.sample(points, grid, ["k"], *PLACE).collect()}
    value = {(x.r, x.c): x for x in grid.collect()}
    got = stored.at(points, ["k"]).collect()
    assert len(got) == len(spots)
    for x, (k, lat, lng) in zip(sorted(got, key=lambda x: x.k), sorted(spots), strict=True):
        near = value[min(rows - 1, max(0, math.floor((PLACE[0] - lat) / PLACE[2] + 0.5))), min(columns - 1, max(0, math.floor((lng - PLACE[1]) / PLACE[3] + 0.5)))]
        assert x.k == k and x.z == pytest.approx(want[k]) and (x.slope, x.ruggedness, x.risk) == (near.slope, near.ruggedness, near.risk)


def test_missing_cells_leave_nothing(spark, tmp_path):
    grid = cells(spark, 3, 3, missing={(1, 1)}).withColumn("risk", F.when(F.col("r") > 0, F.col("risk")))
    stored = terrain.TerrainTiles.create(grid, PLACE, "stored_gaps", f"file://{tmp_path}/tiles", 2)
    at = lambda k, y, x: (k, PLACE[0] - y * PLACE[2], PLACE[1] + x * PLACE[3])
    points = spark.createDataFrame([at(1, 1.0, 1.0), at(2, 0.6, 0.7), at(3, 0.0, 2.0), at(4, 2.0, 2.0)], "k int, lat double, lng double")
    got = {x.k: x for x in stored.at(points, ["k"]).collect()}
    assert got[1].z is None and got[1].slope is None and got[2].z is None and got[3].risk is None and got[3].slope is not None and None not in tuple(got[4])


def test_the_raster_is_not_moved_again(spark, tmp_path):
    """The tiles' side of the join reads its buckets: only the points are exchanged."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = terrain.TerrainTiles.create(cells(spark, 5, 5), PLACE, "stored_plan", f"file://{tmp_path}/tiles", buckets)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stored.at(spark.range(5).selectExpr("id AS k", "54.5 - id * 1e-4 AS lat", "18.4D AS lng"), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
